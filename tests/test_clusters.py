"""Cluster indices against a plain version that compares all rows with all."""

from __future__ import annotations

import numpy as np
import pytest

from spindrift.operators import clusters


def plain(v, label):
    kinds = np.unique(label)
    n, k = len(v), len(kinds)
    centres = np.array([v[label == c].mean(axis=0) for c in kinds])
    sizes = np.array([(label == c).sum() for c in kinds])
    within = sum(((v[label == c] - m) ** 2).sum() for c, m in zip(kinds, centres, strict=True))
    between = (sizes * ((centres - v.mean(axis=0)) ** 2).sum(axis=1)).sum()
    width = np.array([np.sqrt(((v[label == c] - m) ** 2).sum(axis=1)).mean() for c, m in zip(kinds, centres, strict=True)])
    bouldin = []
    for i in range(k):
        ratios = []
        for j in range(k):
            apart = np.sqrt(((centres[i] - centres[j]) ** 2).sum())
            ratios.append((width[i] + width[j]) / apart if apart > 0 else 0)
        bouldin.append(max(ratios))
    d = np.array([np.sqrt(((v - x) ** 2).sum(axis=1)) for x in v])
    s = np.zeros(n)
    for i in range(n):
        own = label == label[i]
        if own.sum() > 1:
            a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, label == c].mean() for c in kinds if c != label[i])
            s[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0
    return between * (n - k) / (within * (k - 1)), float(np.mean(bouldin)), s.mean(), {c: s[label == c].mean() for c in kinds}


@pytest.mark.parametrize("block", [4_096, 16])
def test_indices_equal_plain(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", block)
    rng = np.random.default_rng(11)
    label = np.concatenate([rng.integers(0, 5, 150), [7], np.full(90, 3)])
    v = rng.normal(size=(len(label), 6)) + 1_000 + label[:, None] * np.array([2, 0, 1, 0, 0, 0])
    v[-90:] = v[-90]  # a group of copies, a third of the rows
    rows = [(int(c), [float(x) for x in row], "x") for c, row in zip(label, v, strict=True)]
    odd = [(None, [0.0] * 6, "x"), (1, None, "x"), (1, [None] * 6, "x"), (1, [float("nan")] * 6, "x"), (2, [float("inf")] * 6, "x")]
    df = spark.createDataFrame(rows + odd, "cluster int, v array<double>, name string")
    ch, db, s, each = plain(v, label)
    found = clusters.indices(df).collect()
    assert len(found) == 1 and (found[0].n, found[0].clusters) == (len(v), 6)
    assert np.allclose((found[0].calinski_harabasz, found[0].davies_bouldin, found[0].silhouette), (ch, db, s), rtol=1e-9)
    assert {r.cluster: r.n for r in clusters.silhouettes(df).collect()} == {int(c): int((label == c).sum()) for c in each}
    assert all(abs(r.silhouette - each[r.cluster]) < 1e-9 for r in clusters.silhouettes(df).collect())


def test_few_clusters_and_no_rows(spark):
    kind = "cluster string, v array<double>"
    one = clusters.indices(spark.createDataFrame([("a", [1.0, 2.0]), ("a", [2.0, 2.0])], kind)).head()
    assert (one.n, one.clusters, one.calinski_harabasz, one.davies_bouldin, one.silhouette) == (2, 1, None, None, None)
    none = clusters.indices(spark.createDataFrame([], kind)).collect()
    assert [(r.n, r.clusters, r.calinski_harabasz, r.davies_bouldin, r.silhouette) for r in none] == [(None, 0, None, None, None)]
    alone = clusters.indices(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], kind)).head()
    assert (alone.n, alone.clusters, alone.calinski_harabasz, alone.silhouette) == (2, 2, None, 0.0)
    equal = clusters.indices(spark.createDataFrame([("a", [1.0])] * 3 + [("b", [1.0])] * 2, kind)).head()
    assert (equal.davies_bouldin, equal.silhouette) == (0.0, 0.0)
