"""Edge cases of the operators, and dense steps against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions.bins import bin_of, frame_of, wrapped
from spindrift.operators import geometry, joins, maps, pairs, regression, resampling, signal, windows
from spindrift.plans import models
from spindrift.plans import pairs as pair_plans
from spindrift.sources import tables


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_bins_are_closed_on_either_side(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 2.0, 2.5, 10.0, -1.0, None)], "v double")
    right = [r[0] for r in rows.select(bin_of(F.col("v"), 0, 10, 5)).collect()]
    left = [r[0] for r in rows.select(bin_of(F.col("v"), 0, 10, 5, "left")).collect()]
    assert right == [None, 0, 1, 4, None, None] and left == [0, 1, 1, None, None, None]


def test_frames_floor_or_round_half_to_even(spark):
    rows = spark.createDataFrame([(5,), (15,), (25,)], "us long")
    assert [tuple(r) for r in rows.select(frame_of(F.col("us"), 10), frame_of(F.col("us"), 10, "round")).collect()] == [(0, 0), (1, 2), (2, 2)]


def test_onsets_at_both_ends(spark):
    series = spark.createDataFrame([(0, i, on) for i, on in enumerate([1, 1, 0, 0, 1, 0, 0])], "s int, frame long, on int")
    assert values(windows.event_onsets(series, ["s"]), "onset", "offset") == [(0, 2), (4, 5)]
    never = spark.createDataFrame([(0, i, 0) for i in range(5)], "s int, frame long, on int")
    assert windows.event_onsets(never, ["s"]).count() == 0


def test_thinned_starts_equal_a_walk(spark):
    rng = np.random.default_rng(3)
    v, m = rng.integers(0, 4, 300), 3
    series = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "s int, frame long, value double")
    got = [r.start for r in windows.thinned_starts(windows.runs_in_band(series, ["s"], 1, 3, m), ["s"], m).orderBy("start").collect()]
    wanted = []
    for i in range(300 - m + 1):
        if all(1 <= x <= 3 for x in v[i : i + m]) and (not wanted or i > wanted[-1] + 2 * m):
            wanted.append(i)
    assert got == wanted


def test_peth_before_the_start_has_no_rate(spark):
    counts = spark.createDataFrame([(0, 2), (3, 1)], "frame long, n long")
    found = windows.peth(counts, spark.createDataFrame([(1,)], "onset long"), -2, 2)
    assert values(found, "rel", "rate") == [(-1, 2.0), (-2, None), (0, 0.0), (1, 0.0), (2, 1.0)]


def test_angles_wrap_and_unwrap(spark):
    assert spark.range(1).select(wrapped(F.lit(190.0)), wrapped(F.lit(-190.0))).head() == (-170.0, 170.0)
    series = spark.createDataFrame([(0, i, a) for i, a in enumerate([80.0, 89.0, -88.0, -80.0])], "s int, frame long, angle double")
    assert [r.unwrapped for r in windows.unwrapped(series, ["s"]).orderBy("frame").collect()] == [80.0, 89.0, 92.0, 100.0]


def test_range_join_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    points, lows = rng.integers(0, 1000, 200).tolist(), rng.integers(-50, 1000, 40).tolist()
    p = spark.createDataFrame([(i, t) for i, t in enumerate(points)], "i int, t long")
    v = spark.createDataFrame([(j, lo, lo + 37) for j, lo in enumerate(lows)], "j int, lo long, hi long")
    got = {tuple(r) for r in joins.range_join(p, v, "t", "lo", "hi", 25).select("i", "j").collect()}
    assert got == {(i, j) for i, t in enumerate(points) for j, lo in enumerate(lows) if lo <= t < lo + 37}


def test_units_outside_all_areas_are_dropped(spark):
    areas = spark.createDataFrame([("A", 0, 5, 0), ("B", 3, 8, 1)], "area string, ch_lo int, ch_hi int, rank int")
    units = spark.createDataFrame([(1, 4), (2, 5), (3, 8)], "unit int, ch int")
    assert values(joins.first_range(units, areas, ["unit"], "ch"), "unit", "area") == [(1, "A"), (2, "B")]


def test_smoothing_keeps_a_constant(spark):
    rates = spark.createDataFrame([(0, b, 1.0, 3.0) for b in range(9)], "unit int, bin int, occ double, raw double")
    assert all(math.isclose(r.smoothed, 3.0) for r in maps.smooth(rates, ["unit"], ["bin"], [1.5]).collect())
    assert np.allclose(signal.gaussian_filter(np.full(20, 2.0), 1.5), 2.0)


def test_silent_and_flat_maps_carry_no_information(spark):
    rates = spark.createDataFrame([(u, b, 1.0, float(u)) for u in (0, 2) for b in range(4)], "unit int, bin int, occ double, raw double")
    assert [r.info for r in maps.information_rate(rates, ["unit"]).orderBy("unit").collect()] == [0.0, 0.0]


def test_first_maximum_wins_and_edges_count(spark):
    curves = spark.createDataFrame([(0, b, r, 1.0, 0.5) for b, r in enumerate([5.0, 4.0, 5.0])] + [(1, b, r, 1.0, 0.5) for b, r in enumerate([1.0, 4.0, 2.0])], "unit int, bin int, rate double, sh_mean double, sh_std double")
    assert values(maps.peak_exceeds(curves, ["unit"]), "unit", "peak_bin", "exceeds") == [(0, 0, True), (1, 1, False)]


def test_adaptive_bounds_leave_enough_in_both_edges():
    lo, hi = maps.adaptive_bounds([(float(v), 10.0) for v in range(20, 81)] + [(0.0, 1.0), (100.0, 1.0)], 0, 100, 10, 50)
    assert 10 < lo < 20 and 80 < hi < 90


def test_correlogram_baseline_and_tail(spark):
    cch = spark.createDataFrame([(1, 2, lag, n) for lag, n in ((-2, 3), (0, 9), (1, 4))], "unit1 long, unit2 long, lag int, count long")
    got = pairs.with_baseline(cch, 2, 1.0).orderBy("lag").collect()
    counts = np.array([3, 0, 9, 4, 0.0])
    assert [r["count"] for r in got] == counts.tolist()
    padded, n = np.concatenate((counts[::-1], counts, counts[::-1])), 5
    for i, r in enumerate(got):
        w = np.exp(-0.5 * (np.arange(15) - (n + i)) ** 2)
        w[7] *= 0.4
        mean = (w * padded).sum() / w.sum()
        below = sum(mean**k * math.exp(-mean) / math.factorial(k) for k in range(int(counts[i])))
        tail = abs(1 - below - 0.5 * mean ** counts[i] * math.exp(-mean) / math.factorial(int(counts[i])))
        assert math.isclose(r.baseline, mean, rel_tol=1e-9) and math.isclose(r.p, tail, rel_tol=1e-9, abs_tol=1e-12)


def test_correlogram_turns_with_the_pair(spark):
    bins = spark.createDataFrame([(1, b) for b in (0, 3, 7)] + [(2, b) for b in (1, 3, 9)], "unit long, bin long")
    got = {r.lag: r["count"] for r in pairs.correlogram(bins, 4).collect()}
    wanted = {}
    for a in (0, 3, 7):
        for b in (1, 3, 9):
            if abs(a - b) <= 4:
                wanted[a - b] = wanted.get(a - b, 0) + 1
    assert got == wanted


def test_connection_kinds(spark):
    def rows(peak, p_near, centre):
        return [(peak, 2, lag, 20 if lag == peak else 5, 5.0, 1e-6 if lag == peak else p_near if abs(lag - peak) == 1 else centre if abs(lag) <= 2 else 0.5) for lag in range(-12, 13)]

    cch = spark.createDataFrame(rows(5, 1e-6, 0.5) + rows(6, 1e-6, 1e-6) + rows(7, 0.5, 0.5) + rows(0, 1e-6, 0.5), "unit1 long, unit2 long, lag int, count long, baseline double, p double")
    assert values(pairs.connections(cch), "unit1", "kind", "excitatory") == [(0, "common_input", True), (5, "synaptic", True), (6, "common_input", True), (7, None, None)]


def test_constant_sides_have_no_correlation(spark):
    rows = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 3.0), (1, 1.0, 2.0), (1, 2.0, 4.0), (1, None, 9.0)], "g int, x double, y double")
    assert values(pairs.pearson(rows, ["g"], "x", "y"), "g", "n", "r") == [(0, 2, None), (1, 2, 1.0)]


def test_signed_rank_exact_and_ties(spark):
    assert resampling.signed_rank_exact_greater([1, 2, 3, 4, 5]) == 1 / 32
    assert resampling.signed_rank_exact_greater([0, 0]) == 1.0
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (5.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert resampling.signed_rank(rows, [], "x", "y").select("n", "w_plus", "w_minus").head() == (3, 4.5, 1.5)
    assert resampling.signed_rank(rows, [], "x", "y", zeros="split").select("n", "w_plus", "w_minus").head() == (4, 7.0, 3.0)


def test_jitter_below_zero_is_dropped(spark):
    rows = spark.createDataFrame([(1, i, 5) for i in range(50)], "unit long, id int, us long")
    moved = resampling.jittered(rows, 2, 100, "id")
    assert moved.where("us < 0").count() > 0 and pairs.binary_bins(moved, 10).where("bin < 0").count() == 0


def test_folds_partition_the_frames(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(u, i, int(rng.random() < 0.2 * u)) for u in (0, 1) for i in range(250)], "unit long, frame long, y int")
    got = regression.assign_folds(rows)
    assert got.where("fold IS NULL OR fold < 0 OR fold > 9").count() == 0 and got.count() == 500
    first = got.where("unit = 1 AND y <> 0").orderBy("frame").limit(10).collect()
    assert [r.fold for r in first] == list(range(10))


def test_logistic_fit_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + x @ [1.5, 0.0])))).astype(float)
    n = np.ones(400)
    beta = regression.fit_logistic(x, y, n, 1e-3)
    cost = lambda b: (np.logaddexp(0, b[0] + x @ b[1:]) - y * (b[0] + x @ b[1:])).mean() + 1e-3 * np.abs(b).sum()
    assert all(cost(beta) <= cost(beta + d) + 1e-9 for d in rng.normal(scale=0.01, size=(200, 3)))


def test_selection_finds_the_covariate_that_matters(spark):
    rng = np.random.default_rng(1)
    rows = [(0, i, int(rng.random() < (0.6 if i % 4 == 0 else 0.05)), i % 4, int(rng.integers(0, 3))) for i in range(4000)]
    frames = spark.createDataFrame(rows, "unit long, frame long, y int, a int, b int")
    counts = regression.design_counts(regression.assign_folds(frames), ["a", "b"])
    assert values(regression.forward_selection(counts, ["a", "b"]).where("chosen"), "layer", "model") == [(1, "a")]


def test_all_pairs_and_slices_of_them(spark):
    units = spark.createDataFrame([(u,) for u in (5, 2, 9, 4)], "unit long")
    wanted = [(n, a, b) for n, (a, b) in enumerate([(2, 4), (2, 5), (2, 9), (4, 5), (4, 9), (5, 9)], 1)]
    assert values(pair_plans.keyed_pairs(units), "nth", "first", "second") == wanted
    assert values(pair_plans.keyed_pairs(units, 3, 5), "nth", "first", "second") == wanted[2:5]
    assert pair_plans.keyed_pairs(units.where("unit = 2")).count() == 0


def test_units_are_classed_by_all_their_sessions(spark):
    fired = {1: ["signup", "error", "purchase"], 2: ["error"], 3: ["signup", "purchase"], 4: ["signup", "error"], 5: ["view"], 6: ["view", "click"], 7: ["click"]}
    rows = spark.createDataFrame([(u, kind, day * 86400000000) for u, kinds in fired.items() for day, kind in zip((0, 12, 29), kinds)], "unit long, event_type string, us long")
    assert values(pair_plans.session_kinds(rows), "unit", "kind") == [(1, "all"), (2, "middle"), (3, "outer"), (4, "other")]
    assert values(pair_plans.session_sets(rows), "unit", "op") == [(5, "first"), (6, "both"), (6, "twice")]


def test_models_are_fitted_for_each_unit(spark, sf_dir):
    units = {r.user_id for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().collect()}
    assert len(units) > 4
    for query in (models.glm_cv, models.forward_selection, models.ablation):
        assert {r.unit for r in query(spark, sf_dir).select("unit").collect()} == units


def test_rotations_come_back(spark):
    angles = tuple(F.lit(v) for v in (0.3, -0.7, 1.1))
    back = spark.range(1).select(*geometry.euler_angles(geometry.euler_matrix(angles))).head()
    assert np.allclose(back, (0.3, -0.7, 1.1))
    turn = spark.range(1).select(*geometry.exponential_map(geometry.rotation("y", F.lit(0.8)))).head()
    assert np.allclose(turn, (0, 0.8, 0))
    point = tuple(F.lit(v) for v in (0.0, 0.0, 0.0))
    assert spark.range(1).select(*(c for row in geometry.body_frame(point) for c in row)).head()[0] is None


def test_watershed_parts_two_hills():
    x, y = np.meshgrid(np.arange(20), np.arange(20), indexing="ij")
    image = np.exp(-((x - 5) ** 2 + (y - 5) ** 2) / 8) + np.exp(-((x - 14) ** 2 + (y - 14) ** 2) / 8)
    labels = signal.watershed(image)
    assert labels[5, 5] != labels[14, 14] and set(np.unique(labels)) == {1, 2}


def test_morlet_power_peaks_at_the_period():
    t = np.arange(512)
    power = signal.morlet_power(np.sin(2 * np.pi * t / 16), np.array([4.0, 8.0, 16.0, 32.0]), 1.0)
    assert power.mean(axis=1).argmax() == 2


def test_markers_need_two_labels_and_drop_sentinels(spark):
    rows = [("s", 0, 4, 1.0, 2.0, 3.0), ("s", 0, 5, 4.0, 5.0, 999.0), ("s", 1, 4, 1.0, 1.0, 1.0)]
    got = tables.markers_to_slots(spark.createDataFrame(rows, "session_id string, frame long, marker int, x double, y double, z double")).orderBy("frame").collect()
    assert got[0].m4 == (1.0, 2.0, 3.0) and got[0].m5 == (4.0, 5.0, None) and got[1].m4 is None


@pytest.mark.parametrize("kind", ["parquet", "json", "orc"])
def test_sinks_refuse_an_old_place(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i long, s string")
    tables.write(df, f"{tmp_path}/{kind}", kind)
    assert spark.read.schema(df.schema).format(kind).load(f"{tmp_path}/{kind}").orderBy("i").collect() == df.collect()
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.write(df, f"{tmp_path}/{kind}", kind)


def test_spectrum_and_raw_channels(spark, tmp_path):
    sound = (1000 * np.sin(2 * np.pi * 50 * np.arange(1000) / 1000)).astype("<i2")
    (tmp_path / "a.bin").write_bytes(sound.tobytes())
    top = tables.spectrum(spark, str(tmp_path), 1000.0).orderBy(F.desc("magnitude")).head()
    assert top.hz == 50.0 and abs(top.magnitude - 1000) < 5
    assert tables.raw_channels(spark, str(tmp_path), 4).count() == 250


@pytest.mark.parametrize("most", [8, 24, 1 << 20])
def test_recordings_are_read_by_ranges(spark, tmp_path, most):
    data = np.arange(2 * 4 * 25 + 3, dtype="<i2")
    data.tofile(tmp_path / "a.bin")
    (tmp_path / "empty.bin").touch()
    ranges = tables.file_ranges(spark, str(tmp_path), 8, most).collect()
    assert sum(r.bytes for r in ranges) == 400 and all(r.bytes <= most and r.bytes % 8 == 0 for r in ranges)
    got = sorted(tables.raw_channels(spark, str(tmp_path), 4, most).collect(), key=lambda r: r["sample"])
    assert [r["sample"] for r in got] == list(range(50)) and [x for r in got for x in r["values"]] == list(range(200))
    assert [(r.path.rsplit("/", 1)[1], r.bytes) for r in tables.listing(spark, str(tmp_path), "*.bin").collect()] == [("a.bin", 406)]


def test_variants_must_have_the_same_keys(spark):
    one, two = (spark.createDataFrame(rows, f"k long, {c} string") for rows, c in (([(1, "a"), (2, "b")], "x"), ([(2, "c"), (1, "d")], "y")))
    assert values(joins.merged(one, two, ["k"]), "k", "x", "y") == [(1, "a", "d"), (2, "b", "c")]
    for a, b in ((one.limit(1), two), (one, two.limit(1))):
        with pytest.raises(Exception, match="only one variant"):
            joins.merged(a, b, ["k"]).collect()


def test_decays_are_recovered():
    x = np.linspace(0.1, 10, 80)
    for a, beta, b in ((2.0, 1.5, 0.5), (-1.0, 4.0, 0.0)):
        found = signal.fit_decay(x, a * np.exp(-x / beta) + b * np.exp(-0.5 * ((x - 6) / 0.8) ** 2), 6, 0.8)
        assert np.allclose(found, (a, beta, b), rtol=0.06, atol=0.05)


@pytest.mark.parametrize("mean", [0.3, 7.0, 745.0, 800.5, 3600.0, 1e6])
def test_poisson_tail_equals_exact_sums(mean):
    """Terms summed in 60 digits from both ends of what counts."""
    import decimal

    with decimal.localcontext() as exact:
        exact.prec = 60
        m, spread = decimal.Decimal(mean), int(8 * mean**0.5) + 30
        low = max(0, int(mean) - spread)
        log = -m + (m.ln() * low) - sum((decimal.Decimal(i).ln() for i in range(2, low + 1)), decimal.Decimal(0)) if low < 5000 else None
        if log is None:  # Stirling's series, to far beyond double precision here
            n = decimal.Decimal(low)
            pi = decimal.Decimal("3.14159265358979323846264338327950288419716939937510582097494")
            log = -m + m.ln() * n - (n * n.ln() - n + (2 * pi * n).ln() / 2 + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5) - 1 / (1680 * n**7))
        term, terms = log.exp(), []
        for k in range(low, int(mean) + spread):
            terms.append(term)
            term *= m / (k + 1)
        counts = np.unique(np.linspace(low, len(terms) + low - 1, 25).astype(int))
        above = [float(sum(terms[c - low + 1 :]) + terms[c - low] / 2) for c in counts]
    got = pairs.corrected_tail(counts, np.full(len(counts), mean))
    assert np.allclose(got, above, rtol=1e-9, atol=1e-13)


def test_poisson_tail_edges(spark):
    rows = [(0, 0.0, 0.5), (3, 0.0, 0.0), (None, 2.0, None), (2, None, None), (0, 2.0, 1 - np.exp(-2) / 2), (1200, 800.0, None)]
    got = spark.createDataFrame([(k, m) for k, m, _ in rows], "k long, m double").select(pairs.poisson_tail(F.col("k"), F.col("m")).alias("p")).collect()
    assert got[5].p < 1e-30
    for (*_, want), r in zip(rows[:5], got, strict=False):
        assert r.p is None if want is None else abs(r.p - want) < 1e-12


def test_probe_positions_by_hand(spark):
    """A probe straight down; one that leans by 30 degrees forward (left) and outward (right); a site beside the middle line."""
    rows = [(0.0, 0.0, 35.0, False), (30.0, 0.0, 35.0, False), (30.0, 0.0, 35.0, True), (30.0, 90.0, 35.0, False), (30.0, 90.0, 35.0, True), (0.0, 0.0, 25.0, False), (0.0, 0.0, 25.0, True)]
    frame = spark.createDataFrame(rows, "a double, b double, x double, right boolean")
    at = geometry.probe_position((F.lit(1.0), F.lit(2.0), F.lit(-0.5)), F.lit(5.0), F.col("a"), F.col("b"), F.col("x"), F.lit(1000.0), F.col("right"))
    got = [tuple(r) for r in frame.select(*(c.alias(n) for c, n in zip(at, ("ap", "ml", "dv"), strict=True))).collect()]
    c, m = -0.5 - 4 * np.cos(np.pi / 6), 0.01 * np.sqrt(2)
    wanted = [(1, 2, -4.5), (3, 2, c), (1, 4, c), (1, 0, c), (-1, 2, c), (1 + m, 2 + m, -4.5), (1 - m, 2 - m, -4.5)]
    assert np.allclose(got, wanted)


def integral_of_cosines(low, high, power):
    """By Gauss-Legendre over 64 pieces."""
    nodes, weights = np.polynomial.legendre.leggauss(40)
    edges = np.linspace(low, high, 65)
    mid, half = (edges[1:] + edges[:-1]) / 2, np.diff(edges) / 2
    return float((np.cos(mid[:, None] + half[:, None] * nodes) ** power @ weights * half).sum())


@pytest.mark.parametrize("n", [3, 4, 5, 10, 31, 62, 63, 1000, 1_000_000])
def test_p_of_a_correlation_equals_its_integral(n):
    """r is the sine of an angle whose density under no correlation is a power of its cosine."""
    rs = [v for z in (0.001, 0.2, 1.0, 1.96, 3.0, 6.0) for v in [z / np.sqrt(n)] if v < 1] + [0.5 if n < 1000 else 0.01]
    reach = min(np.pi / 2, 45 / np.sqrt(n))
    whole = integral_of_cosines(0, reach, n - 3)
    wanted = [integral_of_cosines(np.arcsin(r), min(np.pi / 2, np.arcsin(r) + reach), n - 3) / whole for r in rs]
    assert np.allclose(pairs.correlation_tails(np.array(rs), np.full(len(rs), n)), wanted, rtol=1e-9, atol=1e-12)
    assert np.array_equal(pairs.correlation_tails(-np.array(rs), np.full(len(rs), n)), pairs.correlation_tails(np.array(rs), np.full(len(rs), n)))


def test_p_of_odd_correlations(spark):
    rows = [(0.5, 2), (None, 10), (1.0, 10), (-1.0, 3), (0.0, 5), (0.5, None), (0.5, 3)]
    got = [r.p for r in spark.createDataFrame(rows, "r double, n long").select(pairs.pearson_p(F.col("r"), F.col("n")).alias("p")).collect()]
    assert got[:6] == [None, None, 0.0, 0.0, 1.0, None] and abs(got[6] - 2 / 3) < 1e-12


def test_correlations_of_all_suppliers(spark, sf_dir):
    """r by its definition, p by the integral over all angles."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_discount", "l_tax").toPandas().astype(float)
    got = {r.l_suppkey: r for r in pair_plans.correlation_p(spark, sf_dir).collect()}
    assert set(got) == set(rows["l_suppkey"])
    for key, part in rows.groupby("l_suppkey"):
        r = np.corrcoef(part["l_discount"], part["l_tax"])[0, 1]
        reach = min(np.pi / 2, 45 / np.sqrt(len(part)))
        p = integral_of_cosines(np.arcsin(abs(r)), min(np.pi / 2, np.arcsin(abs(r)) + reach), len(part) - 3) / integral_of_cosines(0, reach, len(part) - 3)
        assert got[key].n == len(part) and abs(got[key].r - r) < 1e-5 and abs(got[key].p - p) < 1e-5
