"""Analytics over ordered parameter sweeps: triggers, leading indicators, winners, method comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epsilon_sweep(scores: DataFrame, epsilons: list[float]) -> DataFrame:
    """For each score kind, k and epsilon the mean over records of recall and false positive rate, and how many contexts are emptied.

    scores: record_id, k, is_poison, filterrag_score, query_only_score. Passages that score at least epsilon are
    dropped; null and not-a-number scores are kept. A record's passages are counted once at every threshold, before anything is multiplied.
    """
    kinds = {"full": "filterrag_score", "query_only": "query_only_score"}
    p = F.col("is_poison")
    counts = [F.count("*").alias("_n"), F.count_if(p).alias("_p"), F.count_if(~p).alias("_c")]
    for kind, column in kinds.items():
        score = F.nanvl(column, F.lit(None).cast("double"))
        for i, e in enumerate(epsilons):
            hit = F.coalesce(score >= e, F.lit(False))
            counts += [F.count_if(hit & p).alias(f"_{kind}_{i}_p"), F.count_if(hit & ~p).alias(f"_{kind}_{i}_c"), F.count_if(hit).alias(f"_{kind}_{i}")]
    per = scores.groupBy("record_id", "k").agg(*counts)
    points = [
        F.struct(F.lit(kind).alias("score_kind"), F.lit(float(e)).alias("epsilon"), F.col(f"_{kind}_{i}_p").alias("hp"), F.col(f"_{kind}_{i}_c").alias("hc"), F.col(f"_{kind}_{i}").alias("h"))
        for kind in kinds for i, e in enumerate(epsilons)
    ]
    each = per.select("k", "_n", "_p", "_c", F.explode(F.array(*points)).alias("x"))
    return each.groupBy("x.score_kind", "k", "x.epsilon").agg(
        F.count("*").alias("n"), F.avg(F.try_divide("x.hp", "_p")).alias("mean_recall"), F.avg(F.try_divide("x.hc", "_c")).alias("mean_fpr"), F.count_if(F.col("x.h") == F.col("_n")).alias("empty_contexts")
    )


def recommend(sweep: DataFrame, most_fpr: float = 0.1) -> DataFrame:
    """Thresholds of each score kind in order: those whose worst false positive rate over k qualifies first, then by mean recall (0 and null last), then by size."""
    got = sweep.groupBy("score_kind", "epsilon").agg(F.max("mean_fpr").alias("worst_fpr"), F.avg("mean_recall").alias("mean_recall"))
    got = got.withColumn("qualifies", F.coalesce(F.col("worst_fpr") <= most_fpr, F.lit(False)))
    key = F.when(F.coalesce("mean_recall", F.lit(0.0)) == 0, F.lit(-1.0)).otherwise(F.round("mean_recall", 9))
    order = Window.partitionBy("score_kind").orderBy(F.col("qualifies").desc(), key.desc(), "epsilon")
    return got.withColumn("place", F.row_number().over(order))


def score_summary(scores: DataFrame) -> DataFrame:
    """Counts and means by k, and over all k (k null): grouping sets. Divergent: the two scores differ by more than 1e-9."""
    p = F.col("is_poison")
    far = F.abs(F.col("filterrag_score") - F.col("query_only_score")) > 1e-9
    avg = lambda c: F.avg(F.when(c, F.nanvl("filterrag_score", F.lit(None).cast("double"))))
    return scores.rollup("k").agg(F.count("*").alias("n"), F.count_if(p).alias("n_poison"), F.count_if(F.coalesce(far, F.lit(False))).alias("divergent"), avg(p).alias("mean_poison"), avg(~p).alias("mean_clean"))


def triggers_down(sweep: DataFrame, keys: list[str], param: str, rules: dict[str, str]) -> DataFrame:
    """For each key the first value, going down from the highest (the baseline), at which each rule holds; null if never.

    A rule compares a column with the baseline's as base_<column>.
    """
    baseline = sweep.groupBy(*keys).agg(*[F.max_by(c, param).alias(f"base_{c}") for c in sweep.columns if c not in (*keys, param)])
    joined = sweep.join(baseline, keys)
    return joined.groupBy(*keys).agg(*[F.max(F.when(F.expr(rule), F.col(param))).alias(name) for name, rule in rules.items()])


def first_up(sweep: DataFrame, keys: list[str], param: str, rule: str, name: str) -> DataFrame:
    """The lowest value at which a rule holds."""
    return sweep.groupBy(*keys).agg(F.min(F.when(F.expr(rule), F.col(param))).alias(name))


def any_all(triggers: DataFrame, key: str, trigger: str, limits: list[float], n: int) -> DataFrame:
    """For each limit how many keys have some, and how many exactly ``n``, of their triggers at it or below; null triggers never count."""
    each = triggers.select(key, trigger, F.explode(F.array(*map(F.lit, limits))).alias("at_most"))
    per = each.groupBy(key, "at_most").agg(F.count_if(F.coalesce(F.col(trigger) <= F.col("at_most"), F.lit(False))).alias("_n"))
    return per.groupBy("at_most").agg(F.count_if(F.col("_n") >= 1).alias("any"), F.count_if(F.col("_n") == n).alias("every"))


def winners(df: DataFrame, by: str, contestant: str, value: str) -> DataFrame:
    """How often each contestant has the highest value of its group; ties all win, nulls never do."""
    order = Window.partitionBy(by).orderBy(F.round(value, 9).desc())
    got = df.where(F.col(value).isNotNull()).withColumn("_r", F.rank().over(order)).where("_r = 1")
    return got.groupBy(contestant).agg(F.count("*").alias("wins"))


def leading(indicator: Column, outcome: Column) -> Column:
    """How two triggers (going down) follow each other: the indicator precedes or coincides, comes alone, the outcome comes without or before it, or neither comes."""
    return (
        F.when(indicator.isNotNull() & outcome.isNotNull() & (indicator >= outcome), "precedes_or_coincides").when(outcome.isNotNull(), "outcome_without_indicator_first")
        .when(indicator.isNotNull(), "indicator_without_outcome").otherwise("neither")
    )


def leading_summary(df: DataFrame, indicator: str, outcome: str, keys: list[str] | None = None) -> DataFrame:
    """For each category of ``leading`` (and ``keys``) its rows, mean gap of the two triggers, and the support: the share of those that precede among all with the outcome. Null without one."""
    keys = keys or []
    base = df.select(*keys, leading(F.col(indicator), F.col(outcome)).alias("category"), (F.col(indicator) - F.col(outcome)).alias("_gap"))
    got = base.groupBy(*keys, "category").agg(F.count("*").alias("n"), F.avg("_gap").alias("mean_gap"))
    w = Window.partitionBy(*(keys or [F.lit(0)]))  # four rows
    of = lambda name: F.sum(F.when(F.col("category") == name, F.col("n")).otherwise(0)).over(w)
    return got.withColumn("support", F.try_divide(of("precedes_or_coincides"), of("precedes_or_coincides") + of("outcome_without_indicator_first")))


def compare_methods(df: DataFrame) -> DataFrame:
    """For each method: rows, queries, queries that ever fail, the mean at its strongest setting, and the settings of the first failures.

    df: method, query_id, strength (higher is stronger), failed, value.
    """
    strongest = F.max("strength").over(Window.partitionBy("method", "query_id"))
    per = df.withColumn("_top", F.col("strength") == strongest).groupBy("method", "query_id").agg(F.count("*").alias("_rows"), F.max(F.col("failed")).alias("_failed"), F.avg(F.when(F.col("_top"), F.col("value"))).alias("_v"), F.min(F.when(F.col("failed"), F.col("strength"))).alias("_first"))
    return per.groupBy("method").agg(F.sum("_rows").alias("rows"), F.count("*").alias("queries"), F.count_if("_failed").alias("failing_queries"), F.avg("_v").alias("mean_at_strongest"), F.min("_first").alias("first_failure"))
