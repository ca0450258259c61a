"""Recordings, snippets and ``.npy`` arrays against plain versions, with odd rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import snippets
from spindrift.sources import arrays


def _number(*keys):
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 4294967296.0


@pytest.fixture(scope="module")
def recording():
    return np.random.default_rng(3).integers(-32768, 32768, (3_000, 6)).astype("<i2")


@pytest.fixture(scope="module")
def files(spark, recording, tmp_path_factory):
    """Two sessions; the second in files of odd lengths, one with half a sample at its end and one empty."""
    folder = tmp_path_factory.mktemp("recordings")
    (folder / "a").mkdir()
    (folder / "b").mkdir()
    (folder / "a" / "0.bin").write_bytes(recording[:1_000].tobytes())
    for i, (low, high) in enumerate(((1_000, 1_010), (1_010, 1_011), (1_011, 1_700), (1_700, 3_000))):
        (folder / "b" / f"{i}.bin").write_bytes(recording[low:high].tobytes() + (b"xyz" if i == 2 else b""))
    (folder / "b" / "9.bin").write_bytes(b"")
    return arrays.recording_files(spark, str(folder), 6, F.element_at(F.split("path", "/"), -2))


def test_files_of_a_session_follow_each_other(files):
    rows = sorted((r.session, r.first, r.samples) for r in files.collect())
    assert rows == [("a", 0, 1_000), ("b", 0, 10), ("b", 10, 1), ("b", 11, 689), ("b", 700, 1_300)]


@pytest.mark.parametrize("stretch", [65_536, 64])
def test_snippets_equal_slices(spark, files, recording, monkeypatch, stretch):
    monkeypatch.setattr(snippets, "STRETCH", stretch)
    sessions = {"a": recording[:1_000], "b": recording[1_000:]}
    rng = np.random.default_rng(5)
    rows = [(s, int(u), int(t), int(u) % 6) for s, n in (("a", 1_000), ("b", 2_000)) for u in range(7) for t in [*rng.integers(-5, n + 5, 40), 20, 19, n - 62, n - 61]]
    rows += rows[:50] + [("c", 1, 100, 0), (None, 1, 100, 0), ("a", None, 100, 0), ("a", 1, None, 0), ("a", 2, 100, None), ("a", 3, 101, 9), ("a", 4, 102, -1)]
    spikes = spark.createDataFrame(rows, "session string, unit int, sample bigint, channel int")
    found = snippets.snippets(spikes, files, 6, picks=15)
    pieces = {}
    for r in found.collect():
        pieces.setdefault((r.session, r.unit, r.sample, r.channel), []).append((r.rel, r["values"]))
    whole = {}
    for key, parts in pieces.items():
        at = 0
        for rel, values in sorted(parts):
            assert rel == at
            at += len(values)
        whole[key] = np.concatenate([v for _, v in sorted(parts)])
    wanted = {}
    for s, data in sessions.items():
        for u in range(7):
            fit = {t for a, b, t, c in rows if (a, b) == (s, u) and t is not None and c is not None and 0 <= c < 6 and 20 <= t <= len(data) - 62}
            for t in sorted(fit, key=lambda t: (_number("snippet", s, u, t), t))[:15]:
                for c in range(max(0, u % 6 - 2), min(5, u % 6 + 2) + 1):
                    wanted[s, u, t, c] = data[t - 20 : t + 62, c]
    assert set(wanted) == set(whole)
    assert all((whole[k] == wanted[k]).all() for k in wanted)
    means = {(r.session, r.unit, r.channel, r["at"]): (r.n, r["mean"]) for r in snippets.mean_snippets(found, 2.0).collect()}
    for s, u, c in {(k[0], k[1], k[3]) for k in whole}:
        stack = np.array([v for k, v in whole.items() if (k[0], k[1], k[3]) == (s, u, c)], float)
        for at in range(82):
            n, mean = means[s, u, c, at]
            assert n == len(stack) and abs(mean - 2 * stack[:, at].mean()) < 1e-9


def test_draw_of_hot_and_small_groups(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") < 50_000, 0).otherwise(F.col("id") % 97).cast("int").alias("unit"), "id")
    found = {(r.unit, r.id) for r in snippets.drawn(rows, ["unit"], "id", 300).collect()}
    groups = {}
    for i in range(60_000):
        groups.setdefault(0 if i < 50_000 else i % 97, []).append(i)
    assert found == {(u, i) for u, ids in groups.items() for i in sorted(ids, key=lambda i: (_number("snippet", u, i), i))[:300]}


def test_no_spikes_and_no_files(spark, files):
    none = spark.createDataFrame([], "session string, unit int, sample bigint, channel int")
    assert snippets.snippets(none, files, 6).count() == 0
    one = spark.createDataFrame([("a", 1, 100, 0)], none.schema)
    assert snippets.snippets(one, files.where("false"), 6).count() == 0
    assert snippets.mean_snippets(snippets.snippets(one, files, 6)).count() == 3 * 82


def test_reads_merge_neighbours_and_skip_the_rest(spark, files, recording, monkeypatch):
    for name, value in (("GAP_BYTES", 0), ("READ_BYTES", 1_000), ("READ_PIECES", 3)):
        monkeypatch.setattr(arrays, name, value)
    path = files.where("session = 'a'").head().path
    rows = [(path, t, 5 + t % 9, [t % 6, (t + 1) % 6]) for t in range(0, 900, 7)]
    for r in arrays.ranges_read(spark.createDataFrame(rows, "path string, start bigint, n int, wanted array<int>"), 6).collect():
        assert r["values"] == recording[r.start : r.start + r.n, r.wanted].T.ravel().tolist()


def test_written_recording_must_be_whole(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").alias("sample"), F.array(F.col("id").cast("int"), F.lit(-1)).alias("values"))
    files = arrays.write_recording(rows, str(tmp_path / "good"), 10)
    assert sorted((r.first, r.samples) for r in files.collect()) == [(0, 10), (10, 10), (20, 5)]
    back = np.concatenate([np.fromfile(r.path.removeprefix("file://"), "<i2").reshape(-1, 2) for r in files.orderBy("first").collect()])
    assert back.tolist() == [[i, -1] for i in range(25)]
    for i, bad in enumerate((rows.where("sample <> 12"), rows.union(rows.limit(1)), rows.where("sample >= 10"), rows.where("sample < 10 OR sample >= 20"))):
        with pytest.raises(Exception, match="gaps"):
            arrays.write_recording(bad, str(tmp_path / f"bad{i}"), 10)
    assert arrays.write_recording(rows.where("false"), str(tmp_path / "none"), 10).count() == 0


def test_npy_of_all_shapes_types_and_orders(spark, tmp_path):
    rng = np.random.default_rng(7)
    made = {
        "plain": rng.normal(size=(103, 5)), "fortran": np.asfortranarray(rng.normal(size=(103, 5))), "cube": np.asfortranarray(rng.normal(size=(20, 3, 4))), "cube_rows": rng.normal(size=(20, 3, 4)),
        "line": np.arange(50, dtype=np.int16), "big_endian": np.arange(12, dtype=">f4").reshape(4, 3), "flags": np.array([True, False, True]), "number": np.array(2.5), "none": np.zeros((0, 4)), "thin": np.zeros((3, 0)),
    }
    for name, value in made.items():
        np.save(tmp_path / f"{name}.npy", value)
    for rows in (0, 7):
        found = {}
        for r in arrays.npy(spark, str(tmp_path), rows).collect():
            found.setdefault(r.path.rsplit("/", 1)[1][:-4], {})[r.row] = r["values"]
        for name, value in made.items():
            wanted = value.reshape(len(value) if value.ndim else 1, -1).astype(float) if value.size else np.zeros(value.shape)
            assert [found.get(name, {})[i] for i in range(len(wanted))] == wanted.tolist(), name
    assert [r["values"] for r in arrays.npy(spark, str(tmp_path / "line.npy")).orderBy("row").collect()] == [[float(i)] for i in range(50)]


def test_npy_unpickles_nothing(spark, tmp_path):
    np.save(tmp_path / "objects.npy", np.array([{"a": 1}], object), allow_pickle=True)
    with pytest.raises(Exception, match="no plain numbers"):
        arrays.npy(spark, str(tmp_path)).collect()
