from pyspark.sql import functions as F

from ragtide.operators import batch, metrics, reporting

SWEEP = "query_id string, strategy string, alpha double, n_poison int, removed_poison int, removed_clean int, label string, top_pair_pp int, top_pair_pc int, mean_pp double, coral double, mmd double"


def rows(q, s, removed, pp, coral, mmd):
    return [(q, s, a, 5, r, 0, "x" if r == 5 else "y", p, 1, 0.5, c, m) for a, r, p, c, m in zip((1.0, 0.7, 0.3), removed, pp, coral, mmd, strict=True)]


def test_questions_of_a_batch(spark):
    data = rows("a", "near", (5, 5, 3), (9, 8, 7), (1.0, 0.8, 0.2), (0.5, 0.5, 0.4)) + rows("a", "far", (5, 4, 3), (9, 9, 7), (1.0, 1.0, 0.9), (0.5, 0.6, 0.7)) + rows("b", "near", (5, 5, 5), (9, 9, 9), (1.0, 1.0, 1.0), (0.5, 0.4, 0.3))
    s = batch.extended_summary(spark.createDataFrame(data, SWEEP), ["query_id", "strategy"])
    got = {(r.query_id, r.strategy): r for r in s.collect()}
    near, far, still = got["a", "near"], got["a", "far"], got["b", "near"]
    assert (near.pp_decreased, near.first_residual, near.coral_decreased, near.mmd_decreased, near.first_label_change) == (0.7, 0.3, 0.7, 0.3, 0.3)
    assert (far.pp_decreased, far.first_residual, still.first_residual, still.coral_pearson) == (0.3, 0.7, None, None)
    assert round(near.coral_reduction, 6) == 0.8 and round(far.mmd_reduction, 6) == -0.2 and near.baseline_label == "x" and near.final_label == "y"
    a = {r.distance: r for r in batch.decrease(s).collect()}
    assert (a["coral"].n, a["coral"].lower, a["coral"].informative, a["coral"].positive, a["mmd"].lower, a["mmd"].positive) == (3, 2, 2, 2, 2, 2)
    i = {r.indicator: r for r in batch.indicators(s).collect()}
    assert (i["top_pair_pp"].precedes, i["top_pair_pp"].late, i["top_pair_pp"].neither, i["top_pair_pp"].support) == (1, 1, 1, 0.5)
    assert (i["mmd"].precedes, i["mmd"].alone, i["mmd"].late, i["mean_pp"].support) == (1, 1, 1, 0.0)
    assert i["mmd"].place == 1  # same support as the others, and the least lead
    m = {(r.distance, r.strategy): r.wins for r in batch.movers(s, "query_id", "strategy").collect()}
    assert m == {("coral", "near"): 2, ("coral", "far"): 0, ("mmd", "near"): 2, ("mmd", "far"): 0}
    assert batch.verdict(batch.decrease(s), batch.indicators(s)).first().meaningful is False


def test_examples_by_category(spark):
    data = [(i, 0, 10, i % 2 == 0, s, q) for i, (s, q) in enumerate([(0.9, 0.9), (0.8, 0.1), (0.1, 0.1), (0.2, 0.3), (None, 0.1), (float("nan"), 0.5), (0.7, None)])] + [(9, 0, 5, True, 0.9, 0.1)]
    df = spark.createDataFrame(data, "record_id int, rank int, k int, is_poison boolean, filterrag_score double, query_only_score double")
    got = {}
    for r in reporting.examples(df, 0.5, 1).orderBy("category", "place").collect():
        got.setdefault(r.category, []).append((r.record_id, r.found))
    assert got == {"poison_removed": [(0, 2)], "clean_removed": [(1, 1)], "clean_kept": [(3, 1)], "diverging": [(1, 2)]}


def test_log_and_weights(spark):
    log = "[FilterRAG] SLM device: mps (model=some/model-1)\n[FilterRAG] WARNING: SLM generation failed for a passage"
    r = [tuple(x)[1:] for x in reporting.device_log(spark.createDataFrame([(log,), ("",), (None,)], "t string"), "t").collect()]
    assert r == [("mps", "some/model-1", False, False, True), (None, None, False, False, False), (None, None, False, False, False)]
    w = {x.g: (x.weight, x.mean) for x in reporting.weighted_means(spark.createDataFrame([("a", 1.0, 1), ("a", 4.0, 2), ("a", None, 9), ("b", 1.0, 0)], "g string, v double, w int"), ["g"], "v", "w").collect()}
    assert w == {"a": (3, 3.0), "b": (0, None)}


def test_agreement_and_capped_recall(spark):
    ranked = spark.createDataFrame([("q", i, s) for i, s in enumerate([0.1, 0.9, None, 0.8])], "query_id string, rank int, s double")
    r = metrics.topk_agreement(ranked, ["query_id"], "rank", "s", 2).first()
    assert (r.agreement, r.needed) == (0.5, 3)
    rel = ranked.withColumn("rel", (F.col("rank") < 3).cast("int"))
    relevant = spark.createDataFrame([("q", 3), ("none", 0), ("far", 1)], "query_id string, n_rel int")
    got = {r.query_id: (r.recall_cap, r.hole) for r in metrics.capped_recall(rel, relevant, rel.where("rank = 0"), 2).collect()}
    assert got == {"q": (1.0, 0.5), "far": (0.0, 0.0)}
    m = metrics.macro_average(spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "g string, x double"), "g", ["x"]).first()
    assert (m.groups, m.x) == (2, 75.0)
