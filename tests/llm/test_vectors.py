"""Clusters and hard negatives against brute force."""

import hashlib

import numpy as np
import pytest

from conftest import DATA
from popmeasure.llm import clusters, negatives
from popmeasure.llm.queries import oracle_sql, queries
from test_queries import duck, rows  # noqa: F401  (duck is a fixture)


@pytest.mark.parametrize("name", ["op12_clusters", "op13_negatives"])
def test_same_as_sql(spark, duck, name):  # noqa: F811
    df = queries()[name](spark, DATA)
    got = duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert rows(df.columns, df.collect()) == rows(got.columns, got.fetchall())


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for low, high, d in [(-160, 160, 64), (0, 1, 3), (-1, 1, 1), (-(1 << 26), 1 << 26, 64), (5, 900, 17), (-900, -5, 17)]:
        a, b = rng.integers(low, high, (7, d)), rng.integers(low, high, (50, d))
        assert np.array_equal(negatives.products(a, b), a @ b.T)
    assert negatives.products(np.zeros((2, 4), np.int64), np.zeros((3, 4), np.int64)).tolist() == [[0] * 3] * 2
    extreme = np.full((1, 64), negatives.LARGEST - 1)
    assert negatives.products(extreme, -extreme).tolist() == [[-64 * (negatives.LARGEST - 1) ** 2]]
    with pytest.raises(OverflowError):
        negatives.products(np.full((1, 1000), negatives.LARGEST - 1), np.array([[k] * 1000 for k in (1 - negatives.LARGEST, negatives.LARGEST - 1)]))


def brute_negatives(table, positives=5, negatives=5):
    """table: vec_id, label, vector. The contract, literally, for ids that don't repeat."""
    out = []
    last = lambda i: (i is None, i)
    for anchor, label, v in table:
        if anchor is None or anchor % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w, strict=True)), last(i), i, m) for i, m, w in table if len(w) == len(v)), key=lambda r: r[:2])
        own = [r for r in scored if r[3] == label and r[2] != anchor][:positives]
        for score, _, positive, _ in own:
            fit = [r for r in scored if r[3] != label and 80 * -score <= 100 * -r[0] <= 100 * -score][:negatives]
            out += [(anchor, positive, k + 1, r[2], -score, -r[0]) for k, r in enumerate(fit)]
    return sorted(out, key=str)


def test_hard_negatives_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centers = rng.integers(-90, 90, (4, 8))
    table = [(i, int(rng.integers(0, 3)), [int(x) for x in centers[rng.integers(0, 4)] + rng.integers(-9, 9, 8)]) for i in range(900)]
    # ties: a vector that a third of the rows has; vectors of other lengths; an id that is null; an anchor without fellows
    table = [(i, m, [40] * 8 if i % 3 == 0 else v) for i, m, v in table] + [(1000, 1, [1, 2]), (1001, 1, [2, 2]), (1002, 2, [2, 1]), (1003, 2, []), (None, 1, [1, 1]), (1100, 77, [1] * 8)]
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "CANDIDATES", 100)
    monkeypatch.setattr(negatives, "STEP", 2)
    df = spark.createDataFrame([(*r, "x") for r in table], "vec_id long, label long, vector array<int>, score string")
    got = sorted((tuple(r) for r in negatives.hard_negatives(df).collect()), key=str)
    assert got == brute_negatives(table) and len(got) > 50


def test_hard_negatives_of_odd_tables(spark):
    schema = "vec_id long, label long, vector array<int>"
    assert negatives.hard_negatives(spark.createDataFrame([], schema)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(0, 1, [3])], schema)).count() == 0
    # repeated rows count each, but not as the anchor's own positives
    table = [(0, 1, [10]), (0, 1, [10]), (5, 1, [10]), (5, 1, [10]), (6, 2, [9]), (6, 2, [9])]
    got = sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(table, schema)).collect())
    assert got == [(0, 5, k, 6, 100, 90) for k in (1, 1, 2, 2)]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    table = [(0, [1.0, 2.0]), (1, [None, 1.0]), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [-inf, 0.0]), (5, None), (6, [])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    assert [r[0] for r in df.where(negatives.known()).orderBy("vec_id").collect()] == [0, 6]
    assert df.where("vec_id = 0").select(negatives.whole()).first()[0] == [256, 512]
    assert spark.createDataFrame([([-0.001, 0.999, -1.0],)], "embedding array<float>").select(negatives.whole()).first()[0] == [-1, 255, -256]
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([([1e30],)], "embedding array<double>").select(negatives.whole()).collect()


def brute_clusters(table, clusters, rounds, salt):
    """table: vec_id, vector. vec_id to (cluster, distance, cluster_inertia, inertia, hash), in plain whole numbers."""
    order = sorted(table, key=lambda r: (hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    means = [list(v) for _, v in order[:clusters]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    near = lambda: [min((far(v, c), k) for k, c in enumerate(means)) for _, v in table]
    for _ in range(rounds):
        of = [k for _, k in near()]
        for k in range(len(means)):
            own = [v for (_, v), j in zip(table, of, strict=True) if j == k]
            means[k] = [sum(c) // len(own) for c in zip(*own, strict=True)] if own else means[k]
    last = near()
    inside = {k: sum(d for d, j in last if j == k) for _, k in last}
    return sorted(((i, k, d, inside[k], sum(d for d, _ in last), hashlib.sha256(",".join(map(str, means[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(table, last, strict=True)), key=str)


@pytest.mark.parametrize("largest", [60, 1 << 20, (1 << 27) - 1])
def test_clusters_by_brute_force(spark, monkeypatch, largest):
    rng = np.random.default_rng(3)
    table = [(i, rng.integers(-largest, largest, 20).tolist()) for i in range(150)]
    # a vector that a third of the rows has (so centroids are equal, and some stay empty), repeated ids, and an id that is null
    table = [(i, [7] * 20 if i % 3 == 0 else v) for i, v in table] + [(5, [7] * 20), (5, [7] * 20), (None, [-7] * 20)]
    monkeypatch.setattr(clusters, "ROWS", 32)
    monkeypatch.setattr(clusters, "WIDTH", 6)
    df = spark.createDataFrame([(i, v, 0) for i, v in table], "vec_id long, vector array<int>, cluster int").repartition(3)
    got = sorted((tuple(r) for r in clusters.clustered(df, 20, 12, 4, "2:").collect()), key=str)
    assert got == brute_clusters(table, 12, 4, "2:")


def test_clusters_of_odd_tables(spark):
    schema = "vec_id long, vector array<int>"
    assert clusters.clustered(spark.createDataFrame([], schema), 2, 4, 2, "2:").count() == 0
    got = clusters.clustered(spark.createDataFrame([(9, [1, -1])], schema), 2, 4, 2, "2:").collect()
    assert [tuple(r)[:5] for r in got] == [(9, 0, 0, 0, 0)]
