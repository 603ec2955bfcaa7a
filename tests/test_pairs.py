import numpy as np
import pytest
from pyspark.sql import functions as F

from ragtide.functions import vectors as V
from ragtide.operators import defenses as D
from ragtide.operators import pairs as P

GOLD = [[1, 0.9, 0.85, 0.1], [0.9, 1, 0.88, 0.15], [0.85, 0.88, 1, 0.05], [0.1, 0.15, 0.05, 1]]


def matrix(spark, m, query="q"):
    rows = [(query, i, j, float(m[i][j]), i < 3, j < 3) for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, "query_id string, i int, j int, sim double, pi boolean, pj boolean")


def test_concentration_golden(spark):
    r = P.concentration(matrix(spark, GOLD), ["query_id"]).first()
    assert r.mean_of_means == pytest.approx(0.61625)
    assert r.median_of_medians == pytest.approx(0.85)
    assert (r.n_adv, r.flipped, r.flagged) == (3, False, 3)


def test_uniform_matrix_is_turned_round(spark):
    m = [[1.0 if i == j else 0.5 for j in range(3)] for i in range(3)]
    r = P.concentration(matrix(spark, m), ["query_id"]).first()
    assert (r.flagged, r.flipped, r.n_adv) == (0, True, 3)


def test_pair_frequency_golden(spark):
    pairs = matrix(spark, GOLD)
    passages = spark.createDataFrame([("q", i, f"d{i}", i < 3) for i in range(4)], "query_id string, rank int, doc_id string, is_poison boolean")

    def removed(n):
        est = spark.createDataFrame([("q", n)], "query_id string, n_adv bigint")
        got = P.pair_frequency_removal(passages, pairs, est, ["query_id"]).orderBy("rank").collect()
        return [r.rank for r in got if r.removed], {r.rank: r.pair_score for r in got}

    assert removed(2)[0] == [0, 1]
    assert removed(2)[1][0] == pytest.approx(0.81)
    assert removed(1)[0] == [0]
    assert removed(0)[0] == []
    assert removed(4)[0] == []  # all would go, so none does


def test_distances(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(4, 8)), rng.normal(size=(5, 8))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    rows = [("q", i, f"d{i}", i < 4, [float(v) for v in x]) for i, x in enumerate(np.vstack([a, b]))]
    passages = spark.createDataFrame(rows, "query_id string, rank int, doc_id string, is_poison boolean, embedding array<double>")
    pairs = P.pair_table(passages, ["query_id"])
    want = ((np.cov(a.T) - np.cov(b.T)) ** 2).sum()
    assert P.coral_distance(pairs, ["query_id"]).first().coral == pytest.approx(want)
    k = lambda x, y: np.exp(-((x[:, None] - y[None]) ** 2).sum(-1)).mean()
    assert P.mmd_rbf(pairs, ["query_id"]).first().mmd == pytest.approx(k(a, a) + k(b, b) - 2 * k(a, b))
    still = P.centroid_sweep(passages, ["query_id"], [1.0])
    assert P.preservation(still, ["query_id"]).first().max_displacement == pytest.approx(0, abs=1e-9)


def test_one_class_only(spark):
    rows = [("q", i, f"d{i}", True, [1.0, float(i)]) for i in range(3)]
    passages = spark.createDataFrame(rows, "query_id string, rank int, doc_id string, is_poison boolean, embedding array<double>")
    pairs = P.pair_table(passages, ["query_id"])
    assert P.coral_distance(pairs, ["query_id"]).first().coral is None
    assert P.mmd_rbf(pairs, ["query_id"]).first().mmd is None
    moved = P.centroid_sweep(passages, ["query_id"], [0.5]).first()
    assert list(moved.embedding) == list(moved.original)


def test_ward_and_random_removal(spark):
    x = np.array([[0, 0], [0.1, 0], [0, 0.1], [5, 5], [5.1, 5]])
    assert D.ward_split(x) == (3, 2)
    assert D.ward_split(x[:1]) == (1, 0)
    passages = spark.createDataFrame([("q", i) for i in range(6)], "query_id string, rank int")
    est = spark.createDataFrame([("q", 4)], "query_id string, n_adv bigint")
    assert D.random_same_count(passages, est, ["query_id"]).where("removed").count() == 4


def test_thresholds_keep_nulls(spark):
    rows = [("q", "a", 0.5), ("q", "a", 0.1), ("q", "b", None), ("q", "c", float("nan")), ("q", "d", 0.2)]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, filterrag_score double")
    got = D.apply("density", df, ["query_id"], epsilon=0.2).groupBy("doc_id").agg(F.max("removed").alias("r"), F.min("removed").alias("s"))
    assert {r.doc_id: (r.r, r.s) for r in got.collect()} == {"a": (True, True), "b": (False, False), "c": (False, False), "d": (True, True)}
    with pytest.raises(ValueError, match="no such defense"):
        D.apply("other", df, ["query_id"])


def test_robust_cosine(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([1.0, nan], [1.0, 0.0]), ([inf, 1.0], [0.0, 2.0]), ([nan, None], [1.0, 1.0]), ([1.0, 1.0], [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(V.robust_cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0, -1.0]
    assert [round(sum(x * x for x in r[0]), 9) for r in df.select(V.unit(V.finite(F.col("a")))).collect()] == [1.0, 1.0, 0.0, 1.0]
