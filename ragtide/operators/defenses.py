"""Passage filters. Each flags passages (removed), none deletes, so any diagnostics are one aggregation over the flags."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragtide.functions import vectors as V
from ragtide.operators import pairs as P
from ragtide.sources.tables import durable

KINDS = ("none", "concentration", "singlehop", "oracle", "random", "density", "density_query_only", "classifier")
#: Datasets whose questions need several passages.
MULTI_HOP = ("hotpotqa",)
STOP_WORDS = "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own s same she should so some such t than that the their theirs them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours"


def mode(dataset: Column) -> Column:
    return F.when(dataset.isin(*MULTI_HOP), "multihop").otherwise("singlehop")


def none(passages: DataFrame) -> DataFrame:
    return passages.withColumn("removed", F.lit(False))


def oracle(passages: DataFrame) -> DataFrame:
    return passages.withColumn("removed", F.coalesce(F.col("is_poison"), F.lit(False)))


def random_same_count(passages: DataFrame, estimates: DataFrame, keys: list[str], seed: int = 12) -> DataFrame:
    """As many as estimated, by the order of a hash of seed, group and rank: a fixed draw, the same in any engine.

    Another draw of the same distribution than a generator's, as engines share no generator.
    """
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("rank").cast("string")), 256)
    order = Window.partitionBy(*keys).orderBy(draw)
    return passages.join(estimates.select(*keys, "n_adv"), keys, "left").withColumn("removed", F.row_number().over(order) <= F.coalesce("n_adv", F.lit(0))).drop("n_adv")


def stable_seed(base: str, query: Column) -> Column:
    """The first 16 hexadecimal digits of the hash of base:query as an unsigned number, in text."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(base + ":"), query), 256), 1, 16), 16, 10)


def by_threshold(passages: DataFrame, score: str, epsilon: float) -> DataFrame:
    """Passages that score at least ``epsilon``; null and not-a-number scores are kept. Rows of one doc_id in a group fall together."""
    hit = F.coalesce(F.col(score) >= epsilon, F.lit(False)) & ~F.coalesce(F.isnan(score), F.lit(False))
    return passages.withColumn("removed", F.max(hit).over(Window.partitionBy("query_id", "doc_id")))


def ward_split(vectors: np.ndarray) -> tuple[int, int]:
    """Sizes of the two clusters of a Ward agglomeration (Lance-Williams update on squared distances), larger first."""
    n = len(vectors)
    if n < 2:
        return n, 0
    d = ((vectors[:, None] - vectors[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    for _ in range(n - 2):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        rest = alive.copy()
        rest[[i, j]] = False
        m = size[rest]
        new = ((size[i] + m) * d[i, rest] + (size[j] + m) * d[j, rest] - m * d[i, j]) / (size[i] + size[j] + m)
        d[i, rest] = d[rest, i] = new
        size[i] += size[j]
        alive[j] = False
        d[j, :] = d[:, j] = np.inf
    a, b = sorted(size[alive].astype(int).tolist(), reverse=True)
    return a, b


def ward_sizes(passages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, larger, smaller: sizes of two Ward clusters of each group's vectors; a group is a retrieved set of at most k rows."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a, b = ward_split(np.array(f["embedding"].tolist(), np.float64))
        return f.iloc[:1][keys].assign(larger=a, smaller=b)

    kinds = ", ".join(f"{k} {passages.schema[k].dataType.simpleString()}" for k in keys)
    return passages.select(*keys, V.doubles(F.col("embedding")).alias("embedding")).groupBy(*keys).applyInPandas(run, f"{kinds}, larger int, smaller int")


def tfidf_terms(passages: DataFrame, keys: list[str], text: str = "text", top: int = 5) -> DataFrame:
    """keys, term, weight, place: the ``top`` terms of each group by the sum of L2-normed tf-idf weights, ties by term.

    Terms are words of two characters at least, without English stop words; idf = ln((1 + n) / (1 + df)) + 1.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    each = passages.select(*keys, "rank", F.explode(words).alias("term")).where(~F.col("term").isin(*STOP_WORDS.split()))
    size = passages.groupBy(*keys).agg(F.count("*").alias("_n"))
    tf = each.groupBy(*keys, "rank", "term").agg(F.count("*").alias("_tf")).join(size, keys)
    df = F.count("*").over(Window.partitionBy(*keys, "term"))
    weighted = tf.withColumn("_w", F.col("_tf") * (F.log((1 + F.col("_n")) / (1 + df)) + 1))
    normed = weighted.withColumn("_w", F.col("_w") / F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*keys, "rank"))))
    total = normed.groupBy(*keys, "term").agg(F.sum("_w").alias("weight"))
    order = Window.partitionBy(*keys).orderBy(F.round("weight", 9).desc(), "term")
    return total.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def tfidf_count(passages: DataFrame, keys: list[str], text: str = "text", top: int = 5) -> DataFrame:
    """keys, tfidf_count: passages that hold more than half of their group's top terms, as they are written."""
    terms = tfidf_terms(passages, keys, text, top).groupBy(*keys).agg(F.collect_list("term").alias("_terms"))
    held = F.size(F.filter("_terms", lambda t: F.contains(F.coalesce(text, F.lit("")), t)))
    joined = passages.join(terms, keys, "left")
    return joined.groupBy(*keys).agg(F.count_if(F.coalesce(held > F.floor(F.size("_terms") / 2), F.lit(False))).alias("tfidf_count"))


def singlehop_estimates(passages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n_adv: the smaller Ward cluster if few passages hold the top terms, else the larger."""
    both = ward_sizes(passages, keys).join(tfidf_count(passages, keys, text), keys, "left")
    n = F.col("larger") + F.col("smaller")
    few = (F.col("smaller") > 0) & (F.coalesce("tfidf_count", F.lit(0)) <= F.floor(n / 2))
    return both.select(*keys, F.when(few, F.col("smaller")).otherwise(F.col("larger")).cast("bigint").alias("n_adv"))


def concentration_defense(passages: DataFrame, keys: list[str]) -> DataFrame:
    """The estimate by concentration and the removal by pair frequency."""
    table = durable(P.pair_table(passages, keys))
    return P.pair_frequency_removal(passages, table, P.concentration(table, keys), keys)


def flag_all(passages: DataFrame, keys: list[str]) -> DataFrame:
    """``passages`` once for each filter that needs vectors and labels only, with removed and defense: none, oracle, concentration, random.

    The pair table and the estimate that the last two share are made once.
    """
    pairs = durable(P.pair_table(passages, keys))
    estimates = durable(P.concentration(pairs, keys))
    flagged = P.pair_frequency_removal(passages, pairs, estimates, keys).withColumnRenamed("removed", "_concentration")
    drawn = random_same_count(flagged, estimates, keys).withColumnRenamed("removed", "_random")
    poison = F.coalesce(F.col("is_poison"), F.lit(False))
    kinds = {"none": F.lit(False), "oracle": poison, "concentration": F.col("_concentration"), "random": F.col("_random")}
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("defense"), flag.alias("removed")) for kind, flag in kinds.items()])).alias("_d")
    return drawn.select(*passages.columns, each).select(*passages.columns, "_d.removed", "_d.defense")


def apply(kind: str, passages: DataFrame, keys: list[str], **params: object) -> DataFrame:
    """``passages`` with removed and defense, by the name of a filter."""
    if kind not in KINDS:
        raise ValueError(f"no such defense: {kind}; there are {', '.join(KINDS)}")
    if kind == "none":
        got = none(passages)
    elif kind == "concentration":
        got = concentration_defense(passages, keys).drop("pair_score")
    elif kind == "singlehop":
        got = P.pair_frequency_removal(passages, P.pair_table(passages, keys), singlehop_estimates(passages, keys, str(params.get("text", "text"))), keys).drop("pair_score")
    elif kind == "oracle":
        got = oracle(passages)
    elif kind == "random":
        got = random_same_count(passages, P.concentration(P.pair_table(passages, keys), keys), keys, int(params.get("seed", 12)))
    elif kind == "classifier":
        got = by_threshold(passages, "probability", float(params.get("threshold", 0.5)))
    else:
        got = by_threshold(passages, "query_only_score" if kind.endswith("query_only") else "filterrag_score", float(params.get("epsilon", 0.2)))
    return got.withColumn("defense", F.lit(kind))
