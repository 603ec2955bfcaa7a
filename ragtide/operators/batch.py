"""Questions asked of many sweeps at once: one summary row for each query and strategy, then counts, indicators and winners over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtide.operators import metrics, sweeps

DISTANCES = ("coral", "mmd")
#: A mean correlation above, and a mean support from which a movement counts as meaningful.
CORRELATION, SUPPORT = 0.5, 0.7
INDICATORS = {"top_pair_pp": "pp_decreased", "coral": "coral_decreased", "mmd": "mmd_decreased", "mean_pp": "mean_pp_decreased"}


def extended_summary(sweep: DataFrame, keys: list[str], param: str = "alpha") -> DataFrame:
    """For each key the baseline (highest ``param``) and final (lowest) values, the reductions of the distances, the first triggers going down, and the correlations with ``param``.

    sweep: keys, param, n_poison, removed_poison, removed_clean, label, top_pair_pp, top_pair_pc, mean_pp, coral, mmd. Values are compared at nine decimals.
    """
    r = lambda c: F.round(c, 9)
    rounded = sweep.withColumns({c: r(c) for c in (*DISTANCES, "mean_pp")})
    rules = {
        "pp_decreased": "top_pair_pp < base_top_pair_pp", "pc_increased": "top_pair_pc > base_top_pair_pc", "fewer_poison_removed": "removed_poison < base_removed_poison", "clean_removed_increased": "removed_clean > base_removed_clean",
        "first_residual": "removed_poison < n_poison", "first_label_change": "label <> base_label", "mean_pp_decreased": "mean_pp < base_mean_pp", **{f"{d}_decreased": f"{d} < base_{d}" for d in DISTANCES},
    }
    triggers = sweeps.triggers_down(rounded, keys, param, rules)
    ends = rounded.groupBy(*keys).agg(
        F.max_by("label", param).alias("baseline_label"), F.min_by("label", param).alias("final_label"), F.min(param).alias("least"),
        *[f(d, param).alias(f"{name}_{d}") for d in DISTANCES for f, name in ((F.max_by, "baseline"), (F.min_by, "final"))],
    )
    got = triggers.join(ends, keys)
    for d in DISTANCES:
        got = got.withColumn(f"{d}_reduction", F.col(f"baseline_{d}") - F.col(f"final_{d}")).join(metrics.pearson(rounded, keys, param, d).select(*keys, F.col("pearson").alias(f"{d}_pearson")), keys, "left")
    return got


def decrease(summary: DataFrame) -> DataFrame:
    """Question A, a row each distance: rows whose final value is below the baseline, mean correlation, and how many correlations there are and are positive."""
    each = summary.select(F.explode(F.array(*[F.struct(F.lit(d).alias("distance"), F.col(f"final_{d}").alias("f"), F.col(f"baseline_{d}").alias("b"), F.col(f"{d}_pearson").alias("r")) for d in DISTANCES])).alias("x"))
    return each.groupBy("x.distance").agg(F.count("*").alias("n"), F.count_if(F.col("x.f") < F.col("x.b")).alias("lower"), F.avg("x.r").alias("mean_pearson"), F.count_if(F.col("x.r") > 0).alias("positive"), F.count("x.r").alias("informative"))


def indicators(summary: DataFrame, outcome: str = "first_residual", names: dict[str, str] | None = None) -> DataFrame:
    """Questions B to D, a row each indicator: how often it precedes, comes alone, comes too late or neither comes, the support, the mean lead where it precedes, and its place (support first, then the least lead)."""
    names = names or INDICATORS
    each = summary.select(F.col(outcome).alias("o"), F.explode(F.array(*[F.struct(F.lit(n).alias("indicator"), F.col(c).alias("i")) for n, c in names.items()])).alias("x")).select("x.indicator", "x.i", "o")
    kind = sweeps.leading(F.col("i"), F.col("o"))
    count = lambda c: F.count_if(kind == c)
    got = each.groupBy("indicator").agg(
        count("precedes_or_coincides").alias("precedes"), count("indicator_without_outcome").alias("alone"), count("outcome_without_indicator_first").alias("late"), count("neither").alias("neither"),
        F.avg(F.when(kind == "precedes_or_coincides", F.col("i") - F.col("o"))).alias("mean_lead"),
    )
    got = got.withColumn("support", F.try_divide("precedes", F.col("precedes") + F.col("late")))
    order = Window.orderBy(F.round("support", 9).desc_nulls_last(), F.round("mean_lead", 9).asc_nulls_last(), "indicator")  # one row an indicator
    return got.withColumn("place", F.row_number().over(order))


def movers(summary: DataFrame, query: str, strategy: str) -> DataFrame:
    """Question E, a row each distance and strategy: the mean reduction, and of how many queries it has the largest one (the first by name on ties)."""
    each = summary.select(query, F.col(strategy).alias("strategy"), F.explode(F.array(*[F.struct(F.lit(d).alias("distance"), F.col(f"{d}_reduction").alias("v")) for d in DISTANCES])).alias("x")).select(query, "strategy", "x.distance", "x.v")
    order = Window.partitionBy(query, "distance").orderBy(F.round("v", 9).desc_nulls_last(), "strategy")
    ranked = each.withColumn("_n", F.row_number().over(order))
    return ranked.groupBy("distance", "strategy").agg(F.avg("v").alias("mean_reduction"), F.count_if((F.col("_n") == 1) & F.col("v").isNotNull()).alias("wins"))


def verdict(decreases: DataFrame, leads: DataFrame) -> DataFrame:
    """Question F, one row: mean correlation and mean support of the distances, and whether both show a movement that means something."""
    r = decreases.agg(F.avg("mean_pearson").alias("mean_pearson"))
    s = leads.where(F.col("indicator").isin(*DISTANCES)).agg(F.avg("support").alias("mean_support"))
    return r.crossJoin(s).withColumn("meaningful", F.coalesce((F.col("mean_pearson") > CORRELATION) & (F.col("mean_support") >= SUPPORT), F.lit(False)))  # one row by one row
