import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragtide.operators import mlfilter, providers
from ragtide.plans import catalogue


def test_stand_ins(spark):
    df = spark.createDataFrame([(1, "red red sea", "red"), (2, "red red sea", None), (3, "blue", "green sea")], "id int, text string, slm_answer string")
    corpus = df.select("text").distinct()  # red 2, sea 1, blue 1: 4 tokens, 3 kinds
    got = {r.id: r for r in providers.unigram_logprob(providers.unigram_perplexity(df, "text", corpus, "text"), "slm_answer", corpus, "text").collect()}
    assert len(got) == 3
    assert got[1].perplexity == got[2].perplexity == pytest.approx(math.exp(-(2 * math.log(3 / 8) + math.log(2 / 8)) / 3))
    assert got[3].perplexity == 1.0
    assert [got[i].slm_answer_logprob for i in (1, 2, 3)] == [pytest.approx(math.log(3 / 8)), 0.0, pytest.approx(math.log(1 / 8) + math.log(2 / 8))]
    assert got[1].notes == "perplexity: unigram proxy; slm_answer_logprob: unigram proxy"


def labelled(spark, dataset, n=400):
    """Labels by the parity of one feature: more splits than 6 levels hold."""
    rows = [(dataset, "test" if i % 4 == 0 else "train", (i // 2) % 2 == 0, *[float(i) if c == "perplexity" else 0.0 for c in mlfilter.FEATURES]) for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, split string, is_poison boolean, " + ", ".join(f"{c} double" for c in mlfilter.FEATURES))


def test_forest_is_whole(spark):
    assert {"perplexity", "slm_answer_logprob"} <= set(mlfilter.FEATURES)
    forest = mlfilter.fit(labelled(spark, "msmarco")).stages[-1]
    assert forest.getNumTrees == 100
    assert forest.getOrDefault("maxDepth") == 30


def test_one_model_a_dataset(spark, monkeypatch):
    fitted = []

    def fit(rows, label, kind):
        fitted.append((kind, {r[0] for r in rows.select("dataset").distinct().collect()}, rows.where("split <> 'train'").count()))
        return real(rows, label, kind, trees=2)

    real = mlfilter.fit
    monkeypatch.setattr(mlfilter, "fit", fit)
    both = labelled(spark, "nq").unionByName(labelled(spark, "hotpotqa")).unionByName(labelled(spark, "msmarco").where("is_poison"))
    got = mlfilter.fit_and_score(both)
    assert sorted(fitted, key=str) == [("boosted", {"nq"}, 0), ("forest", {"hotpotqa"}, 0)]
    assert got.count() == both.where("split = 'test'").count()
    assert {r[0] for r in got.where("dataset = 'msmarco'").select("probability").distinct().collect()} == {1.0}
    with pytest.raises(ValueError, match="no model kind"):
        mlfilter.fit_and_score(labelled(spark, "other", 8))


def test_features_shuffle_no_text(spark):
    """Scoring told words apart by (text, word) once, so a text went through a shuffle for each of its words."""
    rows = [(1, "what is red", "red red sea", "red"), (2, "what is blue", "red red sea", None), (3, "what is blue", "blue", "green sea"), (4, "none", None, "blue")]
    df = spark.createDataFrame([(*r, 0.5, 0.5, 0.5, 0.5) for r in rows], "id int, question string, text string, slm_answer string, filterrag_score double, query_only_score double, answer_token_overlap_score double, retrieval_score double")
    plan = providers.unigram_perplexity(df, "text", df.select("text").distinct(), "text")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(text#" not in plan
    made = mlfilter.features(df, passages=df.select("text").unionByName(df.select("text")))
    assert "text" not in made.columns
    got = {r.id: r for r in made.collect()}
    assert len(got) == 4
    assert got[1].perplexity == got[2].perplexity == pytest.approx(math.exp(-(2 * math.log(3 / 8) + math.log(2 / 8)) / 3))
    assert got[3].perplexity == got[4].perplexity == 1.0
    assert [got[i].slm_answer_logprob for i in (1, 2, 3, 4)] == [pytest.approx(math.log(3 / 8)), 0.0, pytest.approx(math.log(1 / 8) + math.log(2 / 8)), pytest.approx(math.log(2 / 8))]
    assert [(got[i].matched_words, got[i].distinct_words, got[i].passage_length) for i in (1, 2, 3, 4)] == [(2, 2, 3), (0, 2, 3), (1, 1, 1), (0, 0, 0)]
    assert got[1].notes == "perplexity: unigram proxy; slm_answer_logprob: unigram proxy"


def test_large_vocabulary_is_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "red red sea"), (2, "blue sea")], "id int, text string")
    few = {r.id: r.perplexity for r in providers.unigram_perplexity(df, "text", df, "text").collect()}
    monkeypatch.setattr(providers, "WORDS", 0)
    assert {r.id: r.perplexity for r in providers.unigram_perplexity(df, "text", df, "text").collect()} == pytest.approx(few)


def test_a_fit_has_few_tasks(spark, monkeypatch):
    """Each task of a fit writes statistics of all open nodes, and the files of a table gave the tasks."""
    seen = []

    class Seen(mlfilter.Pipeline):
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))
            return super().fit(rows)

    monkeypatch.setattr(mlfilter, "Pipeline", Seen)
    mlfilter.fit(labelled(spark, "nq").repartition(16), kind="boosted", trees=1)
    assert seen == [(1, 400)]


def test_features_keep_what_removal_needs(spark, data, monkeypatch):
    """ml_filter ended with an error, as its rows had lost doc_id, by which rows of one document fall together."""
    monkeypatch.setattr(mlfilter, "fit_and_score", lambda rows: rows.where("split = 'test'").withColumn("probability", F.col("is_poison").cast("double")))
    got = catalogue.ml_filter(spark, data).collect()
    assert got
    assert all(r.fp == r.fn == 0 for r in got)
    assert sum(r.tp for r in got) > 0


def fitted_rows(monkeypatch):
    """The numbers of rows that pipelines are fitted on; the bound that there was is set low."""
    seen = []

    class Seen(mlfilter.Pipeline):
        def fit(self, rows):
            seen.append(rows.count())
            return super().fit(rows)

    monkeypatch.setattr(mlfilter, "TRAIN_ROWS", 50, raising=False)
    monkeypatch.setattr(mlfilter, "Pipeline", Seen)
    return seen


def alternating(spark, common, values, each):
    """``common`` rows of value 0 that are not poison, and ``each`` of every other value, poison where it is odd."""
    value = F.when(F.col("id") < common, F.lit(0.0)).otherwise((F.floor((F.col("id") - common) / each) + 1).cast("double"))
    rows = spark.range(common + values * each).withColumn("perplexity", value).withColumn("is_poison", F.col("perplexity") % 2 == 1)
    return rows.withColumns({c: F.lit(0.0) for c in mlfilter.FEATURES if c != "perplexity"})


def test_forest_sees_every_row(spark, monkeypatch):
    """Models were fitted on a sample of the rows, and thresholds came from Spark's sample of 10,000 rows, cut to 32 bins."""
    seen = fitted_rows(monkeypatch)
    rows = alternating(spark, 60_000, 40, 1)
    got = mlfilter.score(mlfilter.fit(rows), rows.where("perplexity > 0")).select("is_poison", "probability").collect()
    assert seen == [60_040]
    assert len(got) == 40
    assert all((r.probability >= 0.5) == r.is_poison for r in got)


def test_splits_are_the_best(spark):
    from ragtide.operators import trees as T

    rng = np.random.default_rng(3)
    x, y, w = rng.integers(0, 12, (4, 200)).astype(float), rng.integers(0, 2, 200), rng.integers(0, 4, 200)
    values, codes = zip(*(np.unique(c, return_inverse=True) for c in x), strict=True)

    def left_over(f, t):  # weighted Gini impurity of both sides
        sides = [(w[m].sum(), (w * y)[m].sum()) for m in (x[f] <= t, x[f] > t)]
        return sum(2 * p * (n - p) / n for n, p in sides if n)

    for seed in range(5):
        feature, threshold, left, value = T.grow(np.stack(codes).astype(np.int32), list(values), y, w, 30, np.random.default_rng(seed))
        f = feature[0]
        assert left_over(f, threshold[0]) == pytest.approx(min(left_over(f, t) for t in range(11)))
        assert any(left_over(g, t) <= left_over(f, threshold[0]) + 1e-9 for g in range(4) for t in range(11))
        got = T.leaves((feature, threshold, left, value), x)
        for key in {tuple(c) for c in x[:, w > 0].T}:  # rows of the same values share a leaf of their own
            same = (x.T == key).all(1)
            assert got[same] == pytest.approx((w * y)[same].sum() / w[same].sum())


def test_boosted_trees_see_every_row(spark, monkeypatch):
    """Boosted trees were fitted on a sample of the rows, and their thresholds came from a sample, cut to 32 bins."""
    seen = fitted_rows(monkeypatch)
    rows = alternating(spark, 6_000, 40, 300)
    got = mlfilter.score(mlfilter.fit(rows, kind="boosted"), rows.where("perplexity > 0")).select("is_poison", "probability").collect()
    assert seen == [18_000]
    assert len(got) == 12_000
    assert all((r.probability >= 0.5) == r.is_poison for r in got)


def test_boosted_by_hand():
    from ragtide.operators import trees as T

    x, y = np.array([np.repeat([1.0, 2, 3], 8), [0.0] * 24]), np.array([0] * 8 + [1] * 14 + [0] * 2)
    (tree,) = T.boosted(x, y, 1, 1)
    p = 14 / 24
    leaf = lambda ones, n: np.log(p / (1 - p)) - 0.3 * (n * p - ones) / (n * p * (1 - p) + 1)  # noqa: E731  as XGBoost's, L2 of 1
    assert (tree[0][0], tree[1][0]) == (0, 1.5)  # of more gain than 2.5
    assert T.leaves(tree, x) == pytest.approx([leaf(0, 8) if v == 1 else leaf(14, 16) for v in x[0]])
    many = np.arange(10_000.0)
    assert len(T.cuts(many)) == 255
    assert np.abs(np.diff(T.cuts(many)) - 10_000 / 256).max() <= 1
    assert list(T.cuts(np.array([3.0, 1, 3, 2]))) == [1.5, 2.5]
