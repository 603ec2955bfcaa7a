"""Row tables that show how a retrieved set was judged: its passages, the two stages of the concentration defense, its similarity matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragtide.operators import pairs as P

#: Characters of a preview.
PREVIEW = 120


def concentration_rows(pairs: DataFrame, keys: list[str], estimates: DataFrame | None = None) -> DataFrame:
    """keys, i and how the estimate saw that passage: its mean and lower median similarity, which of them is high, and whether it ended on the injected side."""
    r = lambda x: F.round(x, 9)
    rows = pairs.groupBy(*keys, "i").agg(F.avg("sim").alias("mean_similarity"), F.expr("percentile_disc(0.5) within group (order by sim)").alias("median_similarity"))
    both = rows.join((estimates if estimates is not None else P.concentration(pairs, keys)).select(*keys, "mean_of_means", "median_of_medians", "flipped"), keys)
    middle = (F.col("mean_of_means") + F.col("median_of_medians")) / 2
    seen = both.withColumn("above_mean", r("mean_similarity") > r("mean_of_means")).withColumn("above_median", r("median_similarity") > r(middle))
    flag = F.col("above_mean") | F.col("above_median")
    return seen.select(*keys, "i", "mean_similarity", "median_similarity", "above_mean", "above_median", (flag != F.col("flipped")).alias("injected_side"))


def class_similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i and the mean similarity of that passage to the poisoned and to the clean ones, itself left out; null where there is none."""
    avg = lambda c: F.avg(F.when(c, F.col("sim")))
    return pairs.groupBy(*keys, "i").agg(avg((F.col("i") != F.col("j")) & F.col("pj")).alias("similarity_to_poison"), avg((F.col("i") != F.col("j")) & ~F.col("pj")).alias("similarity_to_clean"))


def passage_rows(flagged: DataFrame, pairs: DataFrame, estimates: DataFrame, keys: list[str], coordinates: DataFrame | None = None) -> DataFrame:
    """One row for each passage of ``flagged`` (keys, doc_id, rank, is_poison, pair_score, removed, optional score and text) with all that the analysis knows of it.

    rank counts from 1 here, passage_index from 0. A set of one passage has no neighbour: nulls. ``coordinates`` (keys, doc_id, x, y) adds two principal coordinates.
    """
    near = P.neighbours(pairs, keys).select(*keys, "i", F.col("neighbour").alias("neighbour_index"), "neighbour_poison", F.col("sim").alias("neighbour_similarity"))
    got = flagged.withColumn("i", F.col("rank"))
    for other in (concentration_rows(pairs, keys, estimates), near, class_similarity(pairs, keys)):
        got = got.join(other, [*keys, "i"], "left")
    if coordinates is not None:
        got = got.join(coordinates, [*keys, "doc_id"], "left")
    text = F.col("text") if "text" in flagged.columns else F.lit(None).cast("string")
    preview = F.when(F.length(text) > PREVIEW, F.concat(F.substring(text, 1, PREVIEW - 3), F.lit("..."))).otherwise(text)
    return got.select(
        *keys, F.col("i").alias("passage_index"), F.col("doc_id").alias("passage_id"), (F.col("i") + 1).alias("rank"), "is_poison", "removed",
        (F.col("score") if "score" in flagged.columns else F.lit(None).cast("double")).alias("retrieval_score"), preview.alias("text_preview"), "mean_similarity", "median_similarity", "above_mean", "above_median",
        "injected_side", F.coalesce("pair_score", F.lit(0.0)).alias("pair_score"), "neighbour_index", "neighbour_poison", "neighbour_similarity", "similarity_to_poison", "similarity_to_clean",
        *(["x", "y"] if coordinates is not None else []),
    )


def stage1_rows(pairs: DataFrame, estimates: DataFrame, keys: list[str], recorded: DataFrame | None = None) -> DataFrame:
    """One row for each set: its size by label, the means and medians of the estimate, and whether ``recorded`` (keys, n_adv_recorded) agrees; not agreeing where nothing is recorded."""
    sizes = pairs.where("i = j").groupBy(*keys).agg(F.count_if("pi").alias("n_poison"), F.count_if(~F.col("pi")).alias("n_clean"))
    got = estimates.join(sizes, keys).withColumn("threshold", (F.col("mean_of_means") + F.col("median_of_medians")) / 2)
    got = got.join(recorded, keys, "left") if recorded is not None else got.withColumn("n_adv_recorded", F.lit(None).cast("bigint"))
    agrees = F.coalesce(F.col("n_adv") == F.col("n_adv_recorded"), F.lit(False))
    return got.select(*keys, "k", "n_poison", "n_clean", "mean_of_means", "median_of_medians", "threshold", "flagged", "flipped", "n_adv", "n_adv_recorded", agrees.alias("agrees"))


def _list(values: str, form: str, *parts: str) -> Column:
    """A JSON array of the structs of ``values`` (in order of their first field), each printed by ``form``."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(values), lambda x: F.format_string(form, *[x[p] for p in parts])), ","), F.lit("]"))


def stage2_rows(flagged: DataFrame, pairs: DataFrame, estimates: DataFrame, keys: list[str], recorded: DataFrame | None = None) -> DataFrame:
    """One row for each set with the top pairs, their similarities, the scores of all passages and the removed ones, as JSON arrays; agrees: ``recorded`` (keys, rank, removed) removed the same set."""
    top = P.top_pairs(pairs, keys, estimates).groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.collect_list(F.struct("pair_rank", "i", "j", "sim")).alias("_p"))
    held = flagged.groupBy(*keys).agg(F.collect_list(F.struct("rank", F.coalesce("pair_score", F.lit(0.0)).alias("s"))).alias("_s"), F.collect_list(F.when(F.col("removed"), F.struct("rank"))).alias("_r"))
    got = estimates.select(*keys, "n_adv").join(top, keys, "left").join(held, keys, "left")
    if recorded is not None:
        got = got.join(recorded.groupBy(*keys).agg(F.collect_list(F.when(F.col("removed"), F.struct("rank"))).alias("_o")), keys, "left")
    else:
        got = got.withColumn("_o", F.lit(None).cast("array<struct<rank:int>>"))
    empty = F.lit("[]")
    ids = lambda c: F.coalesce(_list(c, "%d", "rank"), empty)
    return got.select(
        *keys, "n_adv", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.coalesce(_list("_p", "[%d,%d,%.6f]", "i", "j", "sim"), empty).alias("top_pairs"), F.coalesce(_list("_p", "%.6f", "sim"), empty).alias("top_similarities"),
        F.coalesce(_list("_s", "%.6f", "s"), empty).alias("pair_scores"), ids("_r").alias("removed"), ids("_o").alias("removed_recorded"), (ids("_r") == ids("_o")).alias("agrees"),
    )


def matrix_rows(flagged: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The similarity matrix in long form with labels and places of a second order: poisoned and removed, poisoned and kept, clean and removed, clean and kept passages, each by rank."""
    order = Window.partitionBy(*keys).orderBy(F.when(F.col("is_poison"), 0).otherwise(1), F.when(F.col("removed"), 0).otherwise(1), "rank")
    mark = F.concat(F.col("rank").cast("string"), F.lit(":"), F.when(F.col("is_poison"), "P").otherwise("C"), F.when(F.col("removed"), "R").otherwise("K"), F.lit(":"), "doc_id")
    placed = flagged.select(*keys, "rank", (F.row_number().over(order) - 1).alias("at"), mark.alias("mark"))
    rows, columns = (placed.select(*keys, F.col("rank").alias(a), F.col("at").alias(f"place_{a}"), F.col("mark").alias(f"mark_{a}")) for a in ("i", "j"))
    return pairs.select(*keys, "i", "j", "sim").join(rows, [*keys, "i"]).join(columns, [*keys, "j"])
