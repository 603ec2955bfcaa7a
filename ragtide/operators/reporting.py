"""Tables that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of defenses in a comparison, and what a log of the small model says.
COMPARED = ("none", "ragdefender_original", "ragdefender", "filterrag", "filterrag_query_only", "oracle_remove_all_poison", "random_remove_same_count")
LOG_PATTERNS = {
    "device": r"\[FilterRAG\] SLM device: (\w+) \(model=",
    "model": r"\[FilterRAG\] SLM device: \w+ \(model=([^)]+)\)",
    "device_fallback": r"\[FilterRAG\] --filterrag_slm_device=\w+ requested but \w+ is not available.*falling back",
    "smoke_test_fallback": r"\[FilterRAG\] WARNING: SLM device=.*failed a smoke-test generation.*falling back to device='cpu'",
    "passage_failure": r"\[FilterRAG\] WARNING: SLM generation failed for a passage",
}
CATEGORIES = ("poison_clique_success", "success_with_clean_false_positives", "residual_poison_failure", "clean_density_failure", "other_or_ambiguous")


def failure_category(removed_poison: Column, removed_clean: Column, n_poison: Column) -> Column:
    """The five categories of findings; a removal of some poison counts as residual whatever else it took."""
    gone = (n_poison > 0) & (removed_poison == n_poison)
    rules = (gone & (removed_clean == 0), gone & (removed_clean > 0), (removed_poison > 0) & (removed_poison < n_poison), (removed_poison == 0) & (removed_clean > 0))
    got = F.when(rules[0], CATEGORIES[0])
    for rule, name in zip(rules[1:], CATEGORIES[1:-1], strict=True):
        got = got.when(rule, name)
    return got.otherwise(CATEGORIES[-1])


def detection_table(means: DataFrame) -> DataFrame:
    """Detection quality first, attack success last, with the place of a row in its dataset's table (k, then defense, model and n_injected)."""
    order = Window.partitionBy("dataset").orderBy("k", "defense", "model", "n_injected")
    return means.select(
        "dataset", F.row_number().over(order).alias("place"), "k", "defense", "model", "n_injected", "n_queries", "mean_n_retrieved_poison", "mean_n_adv_estimated_by_ragdefender", "mean_removed_poison", "mean_removed_clean",
        "mean_residual_poison_fraction", "asr_with_defense", "asr_with_defense_strict",
    )


def comparison_table(means: DataFrame) -> DataFrame:
    """The compared defenses of each dataset and k in their fixed order, all models and numbers of injections."""
    named = F.array(*map(F.lit, COMPARED))
    order = Window.partitionBy("dataset", "k").orderBy(F.array_position(named, F.col("defense")), "model", "n_injected")
    return means.where(F.col("defense").isin(*COMPARED)).select(
        "dataset", "k", F.row_number().over(order).alias("place"), "defense", "model", "n_injected", "mean_residual_poison_fraction", "mean_poison_recall", "mean_clean_false_positive_rate", "asr_with_defense", "asr_with_defense_strict"
    )


def examples(scores: DataFrame, epsilon: float, n: int = 5, k: int = 10) -> DataFrame:
    """Up to ``n`` rows at ``k`` of each category: poison_removed, clean_removed, clean_kept (by record and rank) and diverging (largest difference of the two scores first).

    scores: record_id, rank, k, is_poison, filterrag_score, query_only_score; rows with null or not-a-number scores are in none. found: rows of the category in all.
    """
    rows = scores.where((F.col("k") == k) & F.nanvl("filterrag_score", F.lit(None).cast("double")).isNotNull())
    high, gap = F.col("filterrag_score") >= epsilon, F.abs(F.col("filterrag_score") - F.nanvl("query_only_score", F.lit(None).cast("double")))
    kinds = {"poison_removed": F.col("is_poison") & high, "clean_removed": ~F.col("is_poison") & high, "clean_kept": ~F.col("is_poison") & ~high, "diverging": gap > 1e-9}
    each = rows.withColumn("gap", gap).select("*", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in kinds.items()]))).alias("category"))
    totals = each.groupBy("category").agg(F.count("*").alias("found"))
    first = F.when(F.col("category") == "diverging", -F.round("gap", 9)).otherwise(F.lit(0.0))
    order = Window.partitionBy("category").orderBy(first, "record_id", "rank")
    top = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)  # cut before the shuffle
    return top.join(totals, "category").select("category", "place", "record_id", "rank", "is_poison", "filterrag_score", "query_only_score", "found")


def weighted_means(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Sum of value by weight over the sum of the weights, rows with a null on either side left out; null where the weights sum to 0."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    v, w = F.when(both, F.col(value) * F.col(weight)), F.when(both, F.col(weight))
    return df.groupBy(*keys).agg(F.coalesce(F.sum(w), F.lit(0)).alias("weight"), F.try_divide(F.sum(v), F.sum(w)).alias("mean"))


def device_log(df: DataFrame, text: str) -> DataFrame:
    """``df`` with what a captured log says of the small model: device and model (null if it doesn't say), and whether it fell back or failed."""
    found = {n: F.nullif(F.regexp_extract(text, LOG_PATTERNS[n], 1), F.lit("")) for n in ("device", "model")}
    told = {n: F.coalesce(F.col(text).rlike(LOG_PATTERNS[n]), F.lit(False)) for n in ("device_fallback", "smoke_test_fallback", "passage_failure")}
    return df.withColumns(found | told)
