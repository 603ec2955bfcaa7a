"""What is there: files by name, runs of sweeps, the latest artifact, saved matrices; and examples for fine-tuning with their shards and negatives."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONFIG = "intervention string, anchor_strategy string"
PASSAGE = "array<struct<title:string,text:string>>"
EXAMPLE = f"question string, positive_ctxs {PASSAGE}, negative_ctxs {PASSAGE}, hard_negative_ctxs {PASSAGE}"
#: Names of saved matrices.
MATRIX, ORIGINAL = r"transformed_M_alpha([0-9.]+)\.npy$", "original_M.npy"


def _listing(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """path, modificationTime and length of the files below a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "modificationTime", "length")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def paths(spark: SparkSession, folder: str | None = None, part: str | None = None, given: tuple[str, ...] = (), glob: str = "*.json") -> DataFrame:
    """(place, path): the given paths in their order, then those of a folder whose name holds ``part``, by name; each once, where it comes first."""
    rows = spark.createDataFrame([(0, i, p) for i, p in enumerate(given)], "_kind int, _at int, path string")
    if folder:
        found = _listing(spark, folder, glob).select(F.lit(1).alias("_kind"), F.lit(0).alias("_at"), "path")
        rows = rows.unionByName(found.where(name_of(F.col("path")).contains(part)) if part else found)
    once = rows.groupBy("path").agg(F.min(F.struct("_kind", "_at", "path")).alias("_o"))
    return once.select((F.row_number().over(Window.orderBy("_o")) - 1).alias("place"), "path")  # a listing of files


def sweep_runs(spark: SparkSession, folder: str, glob: str = "*/run_config.json") -> DataFrame:
    """(query_id, intervention, path): the last run folder of each query and intervention, by the folder's name, which begins with its time and ends in _<query>.

    E0 is its own name, the others carry their anchor strategy.
    """
    configs = spark.read.schema(CONFIG).option("multiLine", True).json(f"{folder}/{glob}").select("*", F.col("_metadata.file_path").alias("_file"))
    run = F.regexp_extract("_file", r"^(.*)/[^/]+$", 1)
    slug = F.when(F.col("intervention") == "E0", F.lit("E0")).otherwise(F.concat(F.lit("E1-"), "anchor_strategy"))
    named = configs.select(F.regexp_extract(run, r"_([^_/]+)$", 1).alias("query_id"), slug.alias("intervention"), run.alias("path"))
    return named.groupBy("query_id", "intervention").agg(F.max("path").alias("path"))


def latest_artifact(spark: SparkSession, folder: str, part: str, file_name: str) -> str | None:
    """The path of ``file_name`` in the last folder (by name, which begins with a time) whose name holds ``part``; None if there is none."""
    parent = F.element_at(F.split("path", "/"), -2)
    return _listing(spark, folder, file_name).where(parent.contains(part)).agg(F.max("path")).first()[0]


def matrices(spark: SparkSession, folder: str, digits: int = 6) -> DataFrame:
    """(run, alpha, i, j, sim) of saved matrices, alpha rounded so that it can be joined on; the original matrix stands for alpha 1 in a run that has none for it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(folder)
    alpha = F.regexp_extract("path", MATRIX, 1)
    named = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("run"), F.when(alpha != "", F.round(alpha.cast("double"), digits)).when(name_of(F.col("path")) == ORIGINAL, F.lit(1.0)).alias("alpha"), (alpha == "").alias("_original"), "content")
    first = Window.partitionBy("run", "alpha").orderBy("_original")
    kept = named.where("alpha is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("run", "alpha", "content")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for run, at, content in zip(f["run"], f["alpha"], f["content"], strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                i, j = np.indices(m.shape)
                yield pd.DataFrame({"run": run, "alpha": at, "i": i.ravel(), "j": j.ravel(), "sim": m.ravel().astype(float)})

    return kept.mapInPandas(read, "run string, alpha double, i int, j int, sim double")


def rounded_join(a: DataFrame, b: DataFrame, on: list[str], param: str, digits: int = 6, how: str = "left") -> DataFrame:
    """A join on keys and on a floating parameter that was computed in two ways: an equality of its rounded value, so it stays a hash or sort join. ``a``'s parameter is kept."""
    left, right = a.withColumn("_key", F.round(param, digits)), b.withColumn("_key", F.round(param, digits)).drop(param)
    return left.join(right, [*on, "_key"], how).drop("_key")


def numbered(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """``df`` with counter: 1, 2, ... in the order of its partitions and rows (or of ``order``, over ranges). Only one count a partition is brought together."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_m"))
    ahead = sizes.select("_part", F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(ahead), "_part").withColumn("counter", F.col("_ahead") + within + 1).drop("_id", "_part", "_ahead")


def fine_tuning(spark: SparkSession, files: list[str], rank: int = -1, world: int = 1, most: int | None = None) -> DataFrame:
    """Examples of JSON-lines files and of files that hold one JSON array, in order, with counter; the shard ``rank`` of ``world`` has those whose counter leaves it as rest.

    The first ``most`` examples count if it is positive. Fields an example lacks are null.
    """
    from ragtide.sources.tables import durable

    got = None
    for i, path in enumerate(files):
        one = spark.read.schema(EXAMPLE).option("multiLine", not path.endswith(".jsonl")).json(path).withColumn("_file", F.lit(i))
        got = one if got is None else got.unionByName(one)
    rows = numbered(durable(got.withColumn("_row", F.monotonically_increasing_id())), [F.col("_file"), F.col("_row")]).drop("_file", "_row")
    if most is not None and most > 0:
        rows = rows.where(F.col("counter") <= most)
    return rows if rank < 0 else rows.where(F.col("counter") % world == rank)


def with_negatives(examples: DataFrame, key: str, n: int, hard_ratio: float = 0.0, hard_from: int = 0, seed: int = 12, evaluate: bool = False) -> DataFrame:
    """(key, query, gold, negatives): a gold passage and up to ``n`` negatives of each example as title and text.

    Each of ``n`` draws is hard with probability ``hard_ratio``, as far as there are hard ones from ``hard_from`` on; the others are random ones, as far as there are. Draws go by a
    hash of seed, key and place, so they are the same everywhere; to evaluate, the first passages are taken instead. Null lists have none.
    """
    text = lambda p: F.when(F.length(F.coalesce(p["title"], F.lit(""))) > 0, F.concat_ws(" ", p["title"], p["text"])).otherwise(p["text"])
    none = F.array().cast(PASSAGE)
    have = lambda c: F.coalesce(F.col(c), none)
    draw = lambda what, i: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit(what), i.cast("string")), 256)
    share = lambda what, i: F.conv(F.substring(draw(what, i), 1, 8), 16, 10).cast("double") / 2**32
    mixed = lambda what, c: c if evaluate else F.transform(F.array_sort(F.transform(c, lambda p, i: F.struct(draw(what, i).alias("h"), i.alias("i"), p.alias("p")))), lambda x: x["p"])
    pool = F.slice(have("hard_negative_ctxs"), F.lit(hard_from + 1), F.greatest(F.size(have("hard_negative_ctxs")) - hard_from, F.lit(0)))
    wanted = F.size(F.filter(F.sequence(F.lit(1), F.lit(n)), lambda i: share("kind", i) < hard_ratio)) if n > 0 else F.lit(0)
    hard = F.slice(mixed("hard", pool), F.lit(1), F.least(wanted, F.size(pool)))
    plain = F.slice(mixed("plain", have("negative_ctxs")), F.lit(1), F.greatest(F.lit(0), F.least(F.lit(n) - F.size(hard), F.size(have("negative_ctxs")))))
    gold = F.get(mixed("gold", have("positive_ctxs")), F.lit(0))
    return examples.select(key, F.col("question").alias("query"), text(gold).alias("gold"), F.transform(F.concat(hard, plain), text).alias("negatives"))
