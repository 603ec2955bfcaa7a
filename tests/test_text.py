import pytest
from pyspark.sql import functions as F

from ragtide.functions import text as X
from ragtide.operators import metrics as M

MATCHES = [
    ("no", "does not provide information", True, False), ("no", "No, they are not in the same place", True, True), ("no", "They are not in the same place.", True, False), ("no", "I am not sure.", True, False),
    ("yes", "Yes, they are the same person.", True, True), ("texas", "in Texas", True, True), ("texas", "text as", False, False),
    ("Robert Erskine Childers", "It was Robert Erskine Childers who wrote it.", True, True), ("Robert Erskine Childers", "Childers, Robert Erskine, wrote it.", False, False), (None, "x", None, None), ("x", None, None, None),
    ("", "anything", True, False),
]


def test_matches(spark):
    df = spark.createDataFrame([(t, r) for t, r, _, _ in MATCHES], "t string, r string")
    got = df.select(X.legacy_match(F.col("t"), F.col("r")), X.strict_match(F.col("t"), F.col("r"))).collect()
    assert [tuple(r) for r in got] == [(a, b) for _, _, a, b in MATCHES]


@pytest.mark.parametrize(("given", "want"), [("Yes.", "yes"), ("  No  ", "no"), ("A.", "a"), (".", "."), ("", ""), (None, None)])
def test_clean(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(X.clean(F.col("t"))).first()[0] == want


def test_prompt_parse_and_render(spark):
    t = "Use the contexts. \n\nContexts: [context] \n\nQuery: [question] \n\nAnswer:"
    df = spark.createDataFrame([("why?", ["Text A", "Text B ", "Text C"])], "q string, c array<string>")
    back = df.select(X.parse_contexts(X.render_prompt(t, F.col("q"), F.col("c"))))
    assert back.first()[0] == ["Text A", "Text B", "Text C"]
    assert spark.createDataFrame([("nothing",), (None,)], "t string").select(X.parse_contexts(F.col("t"))).collect()[0][0] is None


def test_density_and_jaccard(spark):
    df = spark.createDataFrame([("texas texas texas is the texas state texas texas", ["texas"]), ("", ["a"]), (None, ["a"]), ("a", [])], "t string, k array<string>")
    assert [r[0] for r in df.select(X.frequency_density(F.col("t"), F.col("k"))).collect()] == [1.5, 0.0, 0.0, 0.0]
    assert spark.createDataFrame([(["a", "b"], ["b", "c"])], "x array<string>, y array<string>").select(X.jaccard(F.col("x"), F.col("y"))).first()[0] == pytest.approx(1 / 3)


def test_exact_and_f1(spark):
    df = spark.createDataFrame([(1, "The cat, sat!", "cat sat"), (2, "a b", "c"), (3, None, "c"), (4, "x x y", "x y y")], "k int, p string, g string")
    got = {r.k: (r.em, r.f1 and round(r.f1, 6)) for r in M.exact_and_f1(df, "k", "p", "g").collect()}
    assert got == {1: (1, 1.0), 2: (0, 0.0), 3: (None, None), 4: (0, round(4 / 6, 6))}


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", True, 0.9), ("a", False, 0.9), ("a", False, 0.1), ("b", True, 0.5)], "g string, y boolean, s double")
    assert {r.g: r.auc for r in M.roc_auc(df, ["g"], "y", "s").collect()} == {"a": 0.75, "b": None}


def test_pearson_guards(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, 1.0)], "g string, x double, y double")
    got = {r.g: r.pearson for r in M.pearson(df, ["g"], "x", "y").collect()}
    assert got["a"] == pytest.approx(1.0)
    assert got["b"] is None
    assert got["c"] is None


def test_group_split(spark):
    df = spark.createDataFrame([(f"q{i % 50}", i) for i in range(500)] + [(None, 1)], "query_id string, x int")
    split = M.group_split(df, "query_id")
    assert split.count() == 50
    assert M.leakage(split, "query_id").count() == 0
    assert split.select("split").distinct().count() == 2
