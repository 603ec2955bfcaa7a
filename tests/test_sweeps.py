import pytest
from pyspark.sql import functions as F

from ragtide.operators import diagnostics as G
from ragtide.operators import sweeps

RULES = {
    "pp": "top_pair_pp < base_top_pair_pp", "pc": "top_pair_pc > base_top_pair_pc", "fewer": "removed_poison < base_removed_poison", "residual": "removed_poison < n_poison", "label": "label <> base_label",
    "clean": "removed_clean > base_removed_clean",
}


def test_triggers(spark):
    rows = [(1.0, 10, 4, 5, 0), (0.9, 10, 4, 5, 0), (0.8, 9, 4, 5, 0), (0.7, 9, 5, 5, 0), (0.6, 9, 5, 4, 0), (0.5, 9, 5, 4, 1)]
    df = spark.createDataFrame([("q", *r, 5) for r in rows], "query_id string, alpha double, top_pair_pp int, top_pair_pc int, removed_poison int, removed_clean int, n_poison int")
    df = df.withColumn("label", G.decision(F.col("removed_poison"), F.col("removed_clean"), F.col("n_poison")))
    r = sweeps.triggers_down(df, ["query_id"], "alpha", RULES).first()
    assert (r.pp, r.pc, r.fewer, r.residual, r.label, r.clean) == (0.8, 0.7, 0.6, 0.6, 0.6, 0.5)
    same = df.withColumns({c: F.lit(5) for c in ("top_pair_pp", "top_pair_pc", "removed_poison")}).withColumn("removed_clean", F.lit(0)).withColumn("label", F.lit("poison_removal_success"))
    assert set(sweeps.triggers_down(same, ["query_id"], "alpha", RULES).first()[1:]) == {None}


def test_record_ratios(spark):
    rows = [("c1", False, False, 0), ("a0", True, True, 1), ("c2", False, True, 2), ("a1", True, False, 3), ("c3", False, False, 4)]
    df = spark.createDataFrame([("q", *r) for r in rows], "query_id string, doc_id string, is_poison boolean, removed boolean, rank int")
    r = G.record(df, ["query_id"]).first()
    assert (r.n_retrieved_poison, r.n_retrieved_clean, r.removed_poison, r.removed_clean, r.poison_recall, round(r.clean_false_positive_rate, 6)) == (2, 3, 1, 1, 0.5, 0.333333)
    assert list(r.removed_doc_ids) == ["a0", "c2"]
    assert round(r.residual_poison_fraction, 6) == 0.333333
    none = G.record(df.where("not is_poison"), ["query_id"]).first()
    assert none.poison_recall is None


def test_leading_and_winners(spark):
    df = spark.createDataFrame([(None, None), (0.5, None), (None, 0.5), (0.7, 0.5), (0.5, 0.5), (0.3, 0.5)], "i double, o double")
    first, alone, late, none = "precedes_or_coincides", "indicator_without_outcome", "outcome_without_indicator_first", "neither"
    assert [r[0] for r in df.select(sweeps.leading(F.col("i"), F.col("o"))).collect()] == [none, alone, late, first, first, late]
    got = {r.category: r for r in sweeps.leading_summary(df, "i", "o").collect()}
    assert {c: r.n for c, r in got.items()} == {none: 1, alone: 1, late: 2, first: 2}
    assert all(r.support == 0.5 for r in got.values())
    assert round(got[first].mean_gap, 6) == 0.1
    w = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.5), ("q", "c", None), ("r", "a", 0.1)], "q string, c string, v double")
    assert {r.c: r.wins for r in sweeps.winners(w, "q", "c", "v").collect()} == {"a": 2, "b": 1}


@pytest.mark.parametrize(
    ("removed_poison", "removed_clean", "n_poison", "label"),
    [
        (5, 0, 5, "poison_removal_success"), (5, 1, 5, "over_removal_success"), (3, 0, 5, "residual_poison_failure"), (3, 2, 5, "residual_poison_with_clean_false_positive"),
        (0, 3, 5, "clean_density_failure"), (0, 0, 5, "no_removal_or_other"), (0, 0, 0, "no_removal_or_other"), (0, 2, 0, "clean_density_failure"), (None, 1, 5, "no_removal_or_other"),
    ],
)
def test_decision(spark, removed_poison, removed_clean, n_poison, label):
    df = spark.createDataFrame([(removed_poison, removed_clean, n_poison)], "p int, c int, n int")
    assert df.select(G.decision(F.col("p"), F.col("c"), F.col("n"))).first()[0] == label


def test_any_and_all_at_or_below(spark):
    rows = [("a", 0.3), ("a", 0.5), ("b", 0.9), ("b", None), ("c", None), ("c", None)]
    got = {r.at_most: (r["any"], r.every) for r in sweeps.any_all(spark.createDataFrame(rows, "q string, alpha double"), "q", "alpha", [0.3, 0.5, 0.9], 2).collect()}
    assert got == {0.3: (1, 0), 0.5: (1, 1), 0.9: (2, 1)}


def test_epsilon_sweep_counts(spark):
    nan = float("nan")
    rows = [(1, 5, True, 0.5, 0.1), (1, 5, False, 0.1, None), (2, 5, True, nan, 0.9), (2, 5, True, 0.2, 0.9), (3, 5, None, None, None)]
    df = spark.createDataFrame(rows, "record_id bigint, k int, is_poison boolean, filterrag_score double, query_only_score double")
    got = {(r.score_kind, r.epsilon): r for r in sweeps.epsilon_sweep(df, [0.1, 0.3]).collect()}
    full = got["full", 0.1]
    assert (full.n, full.mean_recall, full.mean_fpr, full.empty_contexts) == (3, 0.75, 1.0, 1)
    only = got["query_only", 0.3]
    assert (only.mean_recall, only.mean_fpr, only.empty_contexts) == (0.5, 0.0, 1)


def test_epsilon_sweep_of_nothing(spark):
    df = spark.createDataFrame([], "record_id bigint, k int, is_poison boolean, filterrag_score double, query_only_score double")
    assert sweeps.epsilon_sweep(df, [0.1, 0.2]).count() == 0
