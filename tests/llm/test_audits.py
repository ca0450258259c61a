"""Filter interactions, piecewise fingerprints and centroid clustering, against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from compare import difference, oracle
from pyspark.sql import functions as F

from spindrift.llm import centroids, filter_audit, piecewise_hash, queries

LABELS = "doc_id long, quality int, toxic int, n int"
DOCS = "doc_id long, text string, source string, n int, a int"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_centroid_clustering"])
def test_equals_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), oracle(sf_dir), queries.ORACLE_SQL[name]) is None


def plain_audit(docs, labels):
    least, kinds = {}, {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x, *_ in labels:
        good, toxic = kinds.get(i, (False, False))
        kinds[i] = good or q == 1, toxic or x == 1
    rows = []
    for i, t, s, *_ in docs:
        t, words = t or "", (t or "").encode().split()
        failed = {f for f, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t],
        ), strict=True) if bad}
        rows.append((s or "", failed, *(kinds.get(i, (False, False)) if i is not None else (False, False))))
    out, totals = {}, {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for step, f in enumerate(order):
            for part in {r[0] for r in rows}:
                mine = [r for r in rows if r[0] == part]
                gone = [r for r in mine if r[1] & set(order[:step])]
                here = [r for r in mine if f in r[1] and not r[1] & set(order[:step])]
                out[part, order, step + 1] = [len(mine) - len(gone) - len(here), len(here), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)]
                totals[part, f] = totals.get((part, f), 0) + len(here)
    return {k: (*v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    rows = filter_audit.flagged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    joint = filter_audit.joint_failures(rows, "part", list("abcde"), {"rows": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")})
    return filter_audit.audit(joint, "part", "ABCDE", "rows", {"good": "good_lost", "toxic": "toxic_lost"})


def test_audit_equals_replay_on_odd_rows(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["Ab", "cd", "EF", "g", "h#", "ijk"], k=n)) for n in (3, 49, 50, 51, 80)] + [" ".join(f"w{i}" for i in range(60)), "", None, "\t\n", "é" * 30]
    docs = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice([None, "", "s", "t"]), 5, 5) for _ in range(150)]
    docs += docs[:20]
    labels = [(rng.choice([None, *range(30)]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), 3) for _ in range(40)]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audited(spark, docs, labels).collect()}
    assert got == plain_audit(docs, labels)
    assert audited(spark, [], []).count() == 0


def test_fingerprints_of_all_documents(spark, sf_dir):
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()))
    got = {r.doc_id: r for r in queries.QUERIES["op12_document_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = math.floor(len(text) / 4)
        edited = text[: len(text) - n] + following[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (piecewise_hash.fingerprint(text), piecewise_hash.fingerprint(edited))
        assert r.near_edited == plain_likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == plain_likeness(r.fingerprint, piecewise_hash.fingerprint(following))
    long = [r for r in got.values() if r.n_chars > 400]
    assert np.mean([r.near_edited > 0.5 for r in long]) > 0.98 and np.mean([r.near_edited > r.near_next for r in long]) > 0.95


def plain_likeness(a, b):
    """By a full table of edit distances."""
    if a == b:
        return 1.0
    (x, *s), (y, *t) = a.split(":"), b.split(":")
    for i, j in itertools.product(range(2), range(2)):
        if int(x) << i == int(y) << j and (s[i] or t[j]):
            p, q = ([z[k : k + 2] for k in range(0, len(z), 2)] for z in (s[i], t[j]))
            row = list(range(len(q) + 1))
            for m, c in enumerate(p, 1):
                row, old = [m], row
                for k, d in enumerate(q, 1):
                    row.append(old[k - 1] if c == d else 1 + min(old[k], row[-1]))
            return 1 - row[-1] / (len(p) + len(q))
    return 0.0


def test_fingerprints_of_odd_rows(spark):
    rng = random.Random(5)
    story = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(500))
    docs = [(1, story), (1, story), (2, None), (3, ""), (None, "x"), (4, story + "é"), (5, "a" * 100_000), (6, story * 200), (7, "\U0001f600" * 9)] + [(8, "same")] * 50
    frame = spark.createDataFrame([(i, t, "s", 1, 1) for i, t in docs], DOCS).repartition(5)
    got = piecewise_hash.fingerprints(frame).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t in docs)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1 and {r.near_next for r in got if r.doc_id == 1} >= {1.0}
    assert {r.near_edited for r in got if r.doc_id in (2, 3)} == {1.0}
    assert piecewise_hash.fingerprints(frame.limit(0)).count() == 0
    (lone,) = piecewise_hash.fingerprints(frame.where("doc_id = 4")).collect()
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(piecewise_hash.edited_text(story + "é", story + "é").encode()).hexdigest()
    # an edit in the middle leaves most chunks
    assert piecewise_hash.likeness(piecewise_hash.fingerprint(story), piecewise_hash.fingerprint(story[:900] + "here is another" + story[900:])) > 0.9
    other = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(500))
    assert piecewise_hash.likeness(piecewise_hash.fingerprint(story), piecewise_hash.fingerprint(other)) < 0.2


def full_search(v, centres):
    d = ((v[:, None, :] - centres[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("spread", [1, 40])
def test_bounds_give_what_a_full_search_gives(spread):
    """Small whole numbers make many ties; wide ones make bounds work."""
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.integers(-spread, spread + 1, (400, 6)) + c for c in rng.integers(-3 * spread, 3 * spread, (5, 6))])
    centres, state, total = v[:16].copy(), None, 0
    for step in range(6):
        cluster, upper, lower = state or (np.zeros(len(v), np.int64), np.full(len(v), np.inf), np.zeros((len(v), 16)))
        if state:
            far = centroids._root_up(moved) * (moved > 0)
            upper, lower = np.nextafter(upper + far[cluster], np.inf), np.maximum(np.nextafter(lower - far, -np.inf), 0)
        cluster, upper, lower, computed = centroids.nearest(v, centres, cluster, upper, lower)
        best, square = full_search(v, centres)
        assert (cluster == best).all() and (upper**2 >= square).all() and (lower[np.arange(len(v)), cluster] ** 2 <= square).all()
        total += computed if step else 0
        new = np.array([v[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else centres[j] for j in range(16)])
        moved, centres, state = ((new - centres) ** 2).sum(axis=1), new, (cluster, upper, lower)
    assert total < 5 * len(v) * 16 * 0.7


def test_clusters_of_odd_rows(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(40)]), [float(rng.choice([-0.5, 0.013, 0.25, 0.9])) for _ in range(64)], 1) for _ in range(120)]
    rows += [rows[0]] * 60 + [(900, None, 1), (901, [0.5] * 63, 1), (902, [0.5] * 65, 1), (903, [0.5] * 63 + [None], 1), (904, [float("nan")] * 64, 1), (905, [float("inf")] * 64, 1), (906, [], 1), (907, [3e30] + [0.0] * 63, 1)]
    schema = "vec_id long, embedding array<double>, cluster int"
    kept = centroids.vectors(spark.createDataFrame(rows, schema).repartition(3))
    got = centroids.clustered(*centroids.cluster_vectors(kept)).collect()
    plain = [(i, [max(min(math.floor(64 * x), centroids.LARGEST), -centroids.LARGEST) for x in v]) for i, v, _ in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    v = np.array([p[1] for p in plain], np.int64)
    key = lambda p: ("g" if p[0] is None else hashlib.sha256(f"1:{p[0]}".encode()).hexdigest(), p[1])
    centres = np.array([p[1] for p in sorted(plain, key=key)[:16]], np.int64)
    for _ in range(3):
        best, _ = full_search(v, centres)
        centres = np.array([v[best == j].sum(axis=0) // (best == j).sum() if (best == j).any() else centres[j] for j in range(16)])
    best, square = full_search(v, centres)
    want = [(str(i), int(c), int(d), int(square[best == c].sum()), int(square.sum()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), c, d in zip(plain, best, square, strict=True)]
    assert sorted((str(r.vec_id), *r[1:]) for r in got) == sorted(want)
    few = centroids.clustered(*centroids.cluster_vectors(kept.limit(5))).collect()
    assert len(few) == 5
    assert centroids.clustered(*centroids.cluster_vectors(kept.limit(0))).count() == 0
