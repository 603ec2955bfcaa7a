"""Similarity pairs within a retrieved set, and the statistics and removals that follow from them.

Every operator takes the group's key columns, so a sweep is the same plan with one more key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtide.functions import vectors as V
from ragtide.functions.text import entropy


def pair_table(passages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, j, sim, pi, pj (labels) for all ordered pairs of ranks, i = j included. k² rows a group, after top k."""
    p = passages.select(*keys, F.col("rank").alias("i"), F.col("is_poison").alias("pi"), V.unit(V.doubles(F.col("embedding"))).alias("_a"))
    q = passages.select(*keys, F.col("rank").alias("j"), F.col("is_poison").alias("pj"), V.unit(V.doubles(F.col("embedding"))).alias("_b"))
    return p.join(q, keys).select(*keys, "i", "j", V.dot(F.col("_a"), F.col("_b")).alias("sim"), "pi", "pj")


def concentration(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Estimate of the number of injected passages from column means and lower medians of the similarity matrix, diagonal included.

    keys, k, mean_of_means, median_of_medians, flagged, flipped, n_adv. A row is flagged if its mean is above the mean of
    means or its median above the middle of both; the count is turned round if nothing is flagged or the mean isn't below the median.
    """
    r = lambda x: F.round(x, 9)
    rows = pairs.groupBy(*keys, "i").agg(F.avg("sim").alias("_m"), F.expr("percentile_disc(0.5) within group (order by sim)").alias("_d"))
    both = rows.groupBy(*keys).agg(F.count("*").alias("k"), F.avg("_m").alias("mean_of_means"), F.expr("percentile_disc(0.5) within group (order by _d)").alias("median_of_medians"))
    flags = rows.join(both, keys).withColumn("_f", (r("_m") > r("mean_of_means")) | (r("_d") > r((F.col("mean_of_means") + F.col("median_of_medians")) / 2)))
    got = flags.groupBy(*keys, "k", "mean_of_means", "median_of_medians").agg(F.count_if("_f").alias("flagged"))
    straight = (F.col("flagged") > 0) & (r("mean_of_means") < r("median_of_medians"))
    return got.withColumn("flipped", ~straight).withColumn("n_adv", F.when(straight, F.col("flagged")).otherwise(F.col("k") - F.col("flagged")))


def top_pairs(pairs: DataFrame, keys: list[str], estimates: DataFrame) -> DataFrame:
    """The max(1, n(n-1)/2) most similar pairs i < j of each group, n the estimate; ties by i, j."""
    order = Window.partitionBy(*keys).orderBy(F.round("sim", 9).desc(), "i", "j")
    ranked = pairs.where("i < j").join(estimates.select(*keys, "n_adv"), keys).withColumn("pair_rank", F.row_number().over(order))
    return ranked.where(F.col("pair_rank") <= F.greatest(F.lit(1), (F.col("n_adv") * (F.col("n_adv") - 1) / 2).cast("bigint")))


def pair_frequency_removal(passages: DataFrame, pairs: DataFrame, estimates: DataFrame, keys: list[str], power: int = 2) -> DataFrame:
    """``passages`` with pair_score and removed: those most often and most strongly in the top pairs, as many as estimated.

    A pair adds sign(sim) |sim|^power to both ends; ties by first appearance. Only passages in some pair are removed; nothing is
    where the estimate is 0 or all would be.
    """
    ends = top_pairs(pairs, keys, estimates).select(*keys, "n_adv", "sim", F.explode(F.array(F.struct(F.col("i").alias("rank"), (2 * F.col("pair_rank")).alias("seen")), F.struct(F.col("j").alias("rank"), (2 * F.col("pair_rank") + 1).alias("seen")))).alias("e"))
    score = F.sum(F.signum("sim") * F.pow(F.abs("sim"), F.lit(power)))
    scored = ends.groupBy(*keys, "n_adv", F.col("e.rank").alias("rank")).agg(score.alias("pair_score"), F.min("e.seen").alias("_seen"))
    order = Window.partitionBy(*keys).orderBy(F.round("pair_score", 9).desc(), "_seen")
    picked = scored.withColumn("_hit", F.row_number().over(order) <= F.col("n_adv")).select(*keys, "rank", "pair_score", "_hit")
    joined = passages.join(picked, [*keys, "rank"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    group = Window.partitionBy(*keys)
    return joined.withColumn("removed", F.col("_hit") & (F.count_if("_hit").over(group) < F.count("*").over(group))).drop("_hit")


def class_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean similarity of poison-poison, poison-clean and clean-clean pairs i < j, and the highest of two poisoned ones; null where there is none."""
    pp, cc = F.col("pi") & F.col("pj"), ~F.col("pi") & ~F.col("pj")
    avg = lambda c: F.avg(F.when(c, F.col("sim")))
    return pairs.where("i < j").groupBy(*keys).agg(avg(pp).alias("mean_pp"), avg(F.col("pi") != F.col("pj")).alias("mean_pc"), avg(cc).alias("mean_cc"), F.max(F.when(pp, F.col("sim"))).alias("max_pp"))


def pair_mix(top: DataFrame, keys: list[str]) -> DataFrame:
    """How many of the top pairs are poison-poison, mixed and clean-clean."""
    pp, cc = F.col("pi") & F.col("pj"), ~F.col("pi") & ~F.col("pj")
    return top.groupBy(*keys).agg(F.count_if(pp).alias("top_pair_pp"), F.count_if(F.col("pi") != F.col("pj")).alias("top_pair_pc"), F.count_if(cc).alias("top_pair_cc"))


def neighbours(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The most similar other passage of each; the first on ties."""
    best = F.max_by(F.struct("j", "pj", "sim"), F.struct(F.round("sim", 9), -F.col("j")))
    return pairs.where("i <> j").groupBy(*keys, "i", "pi").agg(best.alias("_n")).select(*keys, "i", "pi", F.col("_n.j").alias("neighbour"), F.col("_n.pj").alias("neighbour_poison"), F.col("_n.sim").alias("sim"))


def neighbour_entropy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Share of passages whose neighbour is poisoned, and the entropy of that among poisoned and among clean ones."""
    share = lambda c: F.avg(F.when(c, F.col("neighbour_poison").cast("int")))
    got = neighbours(pairs, keys).groupBy(*keys).agg(share(F.lit(True)).alias("nn_poison_ratio"), entropy(share(F.col("pi"))).alias("entropy_poison"), entropy(share(~F.col("pi"))).alias("entropy_clean"))
    return got


def coral_distance(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Squared Frobenius distance of the covariances of poisoned and clean passages, from the doubly centred Gram blocks; null unless both have two."""
    side = Window.partitionBy(*keys, "pi", "pj")
    centred = F.col("sim") - F.avg("sim").over(Window.partitionBy(*keys, "pi", "pj", "i")) - F.avg("sim").over(Window.partitionBy(*keys, "pi", "pj", "j")) + F.avg("sim").over(side)
    c = pairs.withColumn("_c", centred)
    square = lambda cond: F.sum(F.when(cond, F.col("_c") * F.col("_c")))
    n = lambda cond: F.count_if(cond & (F.col("i") == F.col("j"))) - 1
    got = c.groupBy(*keys).agg(square(F.col("pi") & F.col("pj")).alias("_pp"), square(~F.col("pi") & ~F.col("pj")).alias("_cc"), square(F.col("pi") & ~F.col("pj")).alias("_pc"), n(F.col("pi")).alias("_np"), n(~F.col("pi")).alias("_nc"))
    value = F.col("_pp") / F.pow("_np", F.lit(2)) + F.col("_cc") / F.pow("_nc", F.lit(2)) - 2 * F.col("_pc") / (F.col("_np") * F.col("_nc"))
    return got.select(*keys, F.when((F.col("_np") >= 1) & (F.col("_nc") >= 1), F.greatest(F.lit(0.0), value)).alias("coral"))


def mmd_rbf(pairs: DataFrame, keys: list[str], gamma: float = 1.0) -> DataFrame:
    """Biased squared maximum mean discrepancy of poisoned and clean passages by an RBF kernel on unit vectors."""
    kernel = F.exp(-gamma * F.greatest(F.lit(0.0), 2 - 2 * F.col("sim")))
    avg = lambda c: F.avg(F.when(c, kernel))
    return pairs.groupBy(*keys).agg((avg(F.col("pi") & F.col("pj")) + avg(~F.col("pi") & ~F.col("pj")) - 2 * avg(F.col("pi") & ~F.col("pj"))).alias("mmd"))


def centroid_sweep(passages: DataFrame, keys: list[str], alphas: list[float]) -> DataFrame:
    """``passages`` for every alpha, the poisoned vectors moved towards the clean centroid: alpha z + (1 - alpha) mean, at unit length.

    Groups without clean passages keep their vectors. original has the vector before.
    """
    clean = passages.where("not is_poison").select(*keys, F.posexplode(V.doubles(F.col("embedding"))).alias("_d", "_x"))
    centre = clean.groupBy(*keys, "_d").agg(F.avg("_x").alias("_m")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("_centre"))
    each = passages.join(centre, keys, "left").withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))).withColumn("original", V.doubles(F.col("embedding")))
    moved = V.unit(V.mix(F.col("original"), F.col("_centre"), F.col("alpha"), 1 - F.col("alpha")))
    return each.withColumn("embedding", F.when(F.col("is_poison") & F.col("_centre").isNotNull(), moved).otherwise(F.col("original"))).drop("_centre")


def rank_aligned_sweep(passages: DataFrame, keys: list[str], alphas: list[float]) -> DataFrame:
    """``passages`` for every alpha, each poisoned vector moved towards the clean one of the same place by rank, the places of the clean ones repeating: a join on the place.

    Groups without clean passages keep their vectors. original has the vector before.
    """
    order = Window.partitionBy(*keys, "is_poison").orderBy("rank")
    placed = passages.withColumn("original", V.doubles(F.col("embedding"))).withColumn("_at", F.row_number().over(order) - 1)
    clean = placed.where("not is_poison").select(*keys, "_at", F.col("original").alias("_anchor"))
    sizes = clean.groupBy(*keys).agg(F.count("*").alias("_m"))
    tied = placed.join(sizes, keys, "left").withColumn("_at", F.when(F.col("is_poison"), F.col("_at") % F.col("_m"))).join(clean, [*keys, "_at"], "left")
    each = tied.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    moved = V.unit(V.mix(F.col("original"), F.col("_anchor"), F.col("alpha"), 1 - F.col("alpha")))
    return each.withColumn("embedding", F.when(F.col("_anchor").isNotNull(), moved).otherwise(F.col("original"))).drop("_anchor", "_m", "_at")


def preservation(moved: DataFrame, keys: list[str]) -> DataFrame:
    """Displacement and cosine to the original of the poisoned vectors: mean and extreme."""
    gap = V.norm(V.mix(F.col("embedding"), F.col("original"), F.lit(1.0), F.lit(-1.0)))
    near = V.cosine(F.col("embedding"), F.col("original"))
    return moved.where("is_poison").groupBy(*keys).agg(F.avg(gap).alias("mean_displacement"), F.max(gap).alias("max_displacement"), F.avg(near).alias("mean_cosine"), F.min(near).alias("min_cosine"))
