"""Answer, ranking and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtide.functions.text import answer_normal, contains_run, decomposed, legacy_match, word_tokens
from ragtide.sources.tables import durable


def exact_and_f1(df: DataFrame, key: str, prediction: str, gold: str) -> DataFrame:
    """key, em, f1: normalised equality and the overlap of the bags of words, the best over all golds.

    ``gold`` is a string or an array of them. Null for a null prediction, or where every gold is null; no shared word gives 0. Every row stays.
    """
    several = df.schema[gold].dataType.typeName() == "array"
    words = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    golds = F.filter(F.col(gold) if several else F.array(gold), lambda g: g.isNotNull())
    base = df.select(key, answer_normal(F.col(prediction)).alias("_p"), F.transform(golds, answer_normal).alias("_g")).withColumn("_w", words(F.col("_p")))
    # shared words with multiplicity: for each distinct common word the lesser count
    times = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    shared = lambda g: F.aggregate(F.array_intersect("_w", g), F.lit(0), lambda s, w: s + F.least(times(F.col("_w"), w), times(g, w)))
    f1 = F.array_max(F.transform(F.transform("_g", words), lambda g: F.coalesce(F.try_divide(2.0 * shared(g), F.size("_w") + F.size(g)), F.lit(0.0))))
    asked = F.col("_p").isNotNull() & (F.size("_g") > 0)
    return base.select(key, F.when(asked, F.array_contains("_g", F.col("_p")).cast("int")).alias("em"), F.when(asked, f1).alias("f1"))


def has_answer(df: DataFrame, text: str, answers: str) -> DataFrame:
    """``df`` with has_answer: the words of some answer (a string or an array) are a contiguous run of the text's, both in canonical decomposition; false for a null or empty side."""
    several = df.schema[answers].dataType.typeName() == "array"
    lines = F.transform(F.col(answers) if several else F.array(answers), lambda a: F.translate(F.coalesce(a, F.lit("")), "\n", " "))  # one answer a line
    runs = F.transform(F.split(decomposed(F.array_join(lines, "\n")), "\n"), word_tokens)
    made = df.withColumn("_t", word_tokens(decomposed(F.col(text)))).withColumn("_r", runs)
    return made.withColumn("has_answer", F.coalesce(F.exists("_r", lambda run: contains_run(F.col("_t"), run)), F.lit(False))).drop("_t", "_r")


def hits_curve(ranked: DataFrame, n: int) -> DataFrame:
    """rank, hits: how many queries have a hit at that rank or before; ranks from 0."""
    first = ranked.where("hit").groupBy("query_id").agg(F.min("rank").alias("_b"))
    at = first.groupBy("_b").agg(F.count("*").alias("_m"))
    return ranked.sparkSession.range(n).select(F.col("id").alias("rank")).join(at, F.expr("_b <= rank"), "left").groupBy("rank").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("hits"))


def retrieval_prf(counts: DataFrame, k: int, n: int) -> DataFrame:
    """precision own_hits / k, recall own_hits / n and F1 (0 where both are 0) of each query."""
    p, r = F.col("own_hits") / k, F.col("own_hits") / n
    return counts.select("query_id", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg, ap, recall, precision, rr at ``k``. ranked: query_id, rank, rel; relevant: query_id, n_rel."""
    top = ranked.where((F.col("rank") < k) & (F.col("rel") > 0)).withColumn("_hit", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    got = top.groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 2)).alias("_dcg"), F.sum(F.col("_hit") / (F.col("rank") + 1)).alias("_ap"), F.count("*").alias("_n"), F.min("rank").alias("_first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return relevant.where("n_rel > 0").join(got, "query_id", "left").select(
        "query_id", zero(F.col("_dcg") / ideal).alias("ndcg"), zero(F.col("_ap") / F.least("n_rel", F.lit(k))).alias("ap"), zero(F.col("_n") / F.col("n_rel")).alias("recall"),
        zero(F.col("_n") / k).alias("precision"), zero(1 / (F.col("_first") + 1)).alias("rr"),
    )


def capped_recall(ranked: DataFrame, relevant: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """query_id, recall_cap (hits at ``k`` over the lesser of k and the relevant ones) and hole (share of the first k that ``judged`` (query_id, rank) doesn't hold)."""
    top = ranked.where(F.col("rank") < k)
    hits = top.where("rel > 0").groupBy("query_id").agg(F.count("*").alias("_h"))
    known = judged.select("query_id", "rank").distinct().withColumn("_known", F.lit(True))
    holes = top.join(known, ["query_id", "rank"], "left").groupBy("query_id").agg((F.count_if(F.col("_known").isNull()) / k).alias("hole"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    got = relevant.where("n_rel > 0").join(hits, "query_id", "left").join(holes, "query_id", "left")
    return got.select("query_id", zero(F.col("_h") / F.least("n_rel", F.lit(k))).alias("recall_cap"), zero(F.col("hole")).alias("hole"))


def macro_average(per_query: DataFrame, group: str, names: list[str]) -> DataFrame:
    """A hundred times the mean over groups of the means of each group, and the number of groups: every group counts alike."""
    per = per_query.groupBy(group).agg(*[F.avg(n).alias(n) for n in names])
    return per.agg(F.count("*").alias("groups"), *[(100 * F.avg(n)).alias(n) for n in names])


def topk_agreement(ranked: DataFrame, by: list[str], gold: str, score: str, k: int) -> DataFrame:
    """by, agreement (share of the first ``k`` by ``score`` that are in the first k by ``gold``) and needed (rows by score until all of the gold first k are seen).

    ``gold`` counts from 0 in the gold order; scores are highest first, ties by gold. Null scores come last.
    """
    order = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), gold)
    placed = ranked.withColumn("_at", F.row_number().over(order))
    among = F.col(gold) < k
    return placed.groupBy(*by).agg((F.count_if(among & (F.col("_at") <= k)) / F.least(F.count("*"), F.lit(k))).alias("agreement"), F.coalesce(F.max(F.when(among, F.col("_at"))), F.lit(0)).alias("needed"))


def success_by_iteration(records: DataFrame, run: str, iteration: str, target: str, output: str) -> DataFrame:
    """run, iteration, n (records with a target), hits, asr, and mean_asr over the run's iterations, rounded to two decimals, half to even."""
    hit = F.coalesce(legacy_match(F.col(target), F.col(output)), F.lit(False))
    per = records.where(F.col(target).isNotNull()).groupBy(run, iteration).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).withColumn("asr", F.col("hits") / F.col("n"))
    return per.withColumn("mean_asr", F.bround(F.avg("asr").over(Window.partitionBy(run)), 2))


def success_by_run(records: DataFrame, run: str, target: str, with_defense: str, without: str) -> DataFrame:
    """run, n (records with a target), asr_with_defense and asr_no_defense over the same n; the latter is null where a run has no output without defense."""
    hits = lambda c: F.count_if(F.coalesce(legacy_match(F.col(target), F.col(c)), F.lit(False)))
    got = records.where(F.col(target).isNotNull()).groupBy(run).agg(F.count("*").alias("n"), hits(with_defense).alias("_w"), hits(without).alias("_o"), F.count(without).alias("_k"))
    return got.select(run, "n", F.try_divide("_w", "n").alias("asr_with_defense"), F.when(F.col("_k") > 0, F.try_divide("_o", "n")).alias("asr_no_defense"))


def rank_inversions(ranked: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pairs of a group ordered one way by ``a`` and the other way by ``b``. Groups are retrieved sets, at most k rows."""
    x = ranked.select(*by, F.col(a).alias("_a"), F.col(b).alias("_b"))
    y = ranked.select(*by, F.col(a).alias("_c"), F.col(b).alias("_d"))
    pairs = x.join(y, by).where("_a < _c")
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if(F.col("_b") > F.col("_d")).alias("inversions"))


def confusion(df: DataFrame, keys: list[str], label: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 (0 where undefined)."""
    y, p = F.col(label), F.col(predicted)
    got = df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    zero = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    return got.select("*", zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), zero(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), zero(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def roc_auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """The area under the ROC curve from counts by distinct score (ties half); null with one class.

    Distinct scores are dealt to tasks by range, so a group of any size is summed in pieces: each piece counts the negatives
    before a score, and the negatives of the pieces before it are added from a table of one row a group and piece.
    """
    by = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col(label)).alias("_p"), F.count_if(~F.col(label)).alias("_n"))
    dealt = durable(by.repartitionByRange(*keys, score).withColumn("_piece", F.spark_partition_id()))
    piece = Window.partitionBy(*keys, "_piece").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "_piece").agg(F.sum("_n").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(earlier), F.lit(0))).drop("_m")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    ahead = dealt.withColumn("_within", F.coalesce(F.sum("_n").over(piece), F.lit(0))).alias("l").join(totals.alias("r"), match & (F.col("l._piece") == F.col("r._piece"))).select("l.*", "r._before")
    got = ahead.withColumn("_u", F.col("_p") * (F.col("_before") + F.col("_within") + F.col("_n") / 2)).groupBy(*keys).agg(F.sum("_u").alias("_u"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return got.select(*keys, F.try_divide("_u", F.col("_p") * F.col("_n")).alias("auc"))


def pearson(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """The correlation of two columns; null with fewer than two rows or where either is constant."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop(a, b).alias("_c"), F.stddev_pop(a).alias("_a"), F.stddev_pop(b).alias("_b"))
    return both.select(*keys, "n", F.when((F.col("n") >= 2) & (F.col("_a") > 1e-12) & (F.col("_b") > 1e-12), F.col("_c") / (F.col("_a") * F.col("_b"))).alias("pearson"))


def group_split(df: DataFrame, key: str, fraction: float = 0.2, seed: int = 12, by: list[str] | None = None) -> DataFrame:
    """(by, key, split): the first of the distinct non-null keys by their hash are test, the others train; rows of one key never part.

    Test has n * fraction keys, rounded half to even, but one at least, for each group of ``by``. The hash's first digits deal the keys
    into 4096 buckets; only the bucket that the boundary falls into decides by the order inside, so no group is ranked in one task.
    """
    by = by or []
    ids = df.where(F.col(key).isNotNull()).select(*by, F.col(key).cast("string").alias(key)).distinct()
    placed = ids.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256)).withColumn("_b", F.substring("_h", 1, 3))
    counts = placed.groupBy(*by, "_b").agg(F.count("*").alias("_m"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))  # at most 4096 rows
    before = F.coalesce(F.sum("_m").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumn("_test", F.greatest(F.lit(1), F.bround(F.sum("_m").over(whole) * fraction, 0).cast("bigint"))).drop("_m")
    match = F.col("l._b") == F.col("r._b")
    for k in by:
        match = match & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = placed.alias("l").join(counts.alias("r"), match).select("l.*", "_before", "_test")
    at = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h")) + F.col("_before")
    return joined.select(*by, key, F.when(at <= F.col("_test"), "test").otherwise("train").alias("split"))


def leakage(split: DataFrame, key: str) -> DataFrame:
    """Keys in both train and test; empty for a group split."""
    return split.where("split = 'train'").select(key).intersect(split.where("split = 'test'").select(key))
