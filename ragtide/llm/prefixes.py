"""Values that are strict prefixes of longer values, by one global sort."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtide.sources.tables import durable


def longer_copies(values: DataFrame, column: str, copies: str | None = None) -> DataFrame:
    """(``column``, rest) for each distinct value that a longer one begins with; rest: what the next longer one goes on with.

    Only values with the flag ``copies`` (a boolean column; all without it) count as longer ones. In sorted order the values that
    begin with v follow v at once, so v has a longer copy if and only if the next copy behind it is one. Values are deduplicated,
    range-partitioned (a hot prefix is only a longer stretch of the order, split like any other) and each partition is read once in order;
    values behind a partition's last copy meet the first copy of a later partition through a table of one row a partition.
    Null and empty values are left out.
    """
    spark = values.sparkSession
    flag = F.max(F.col(copies) if copies else F.lit(True)).alias("_c")
    distinct = values.select(F.col(column).alias("_v"), *([copies] if copies else [])).where("_v <> ''").groupBy("_v").agg(flag)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = distinct.repartitionByRange(parts, "_v").sortWithinPartitions("_v")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, waiting, part = None, [], TaskContext.get().partitionId()
        for f in frames:
            found = []
            for v, copy in zip(f["_v"], f["_c"], strict=True):
                if copy:
                    first = v if first is None else first
                    found += [(a, v[len(a) :]) for a in waiting if v.startswith(a)]
                    waiting = []
                waiting.append(v)
            if found:
                yield pd.DataFrame({"part": part, "kind": "inner", "_v": [a for a, _ in found], "rest": [b for _, b in found]})
        if first is not None:
            yield pd.DataFrame({"part": [part], "kind": ["first"], "_v": [first], "rest": [""]})
        if waiting:
            yield pd.DataFrame({"part": part, "kind": "waiting", "_v": waiting, "rest": ""})

    found = durable(ordered.mapInPandas(scan, "part int, kind string, _v string, rest string"))
    later = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    known = found.where("kind = 'first'").select("part", F.col("_v").alias("_first"))
    every = spark.range(parts).select(F.col("id").cast("int").alias("part")).join(known, "part", "left")  # one row a partition
    edges = every.select("part", F.first("_first", ignorenulls=True).over(later).alias("_next"))
    seams = found.where("kind = 'waiting'").join(edges, "part").where(F.col("_next").startswith(F.col("_v"))).select("_v", F.expr("substr(_next, length(_v) + 1)").alias("rest"))
    return found.where("kind = 'inner'").select("_v", "rest").unionByName(seams).withColumnRenamed("_v", column)
