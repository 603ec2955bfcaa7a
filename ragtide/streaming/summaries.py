"""Running summaries over diagnostic records as they are appended."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ragtide.sources.tables import discard_at_end, shared_folder


def read_stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Parquet files of a path (a folder or a pattern) as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def running_summary(records: DataFrame) -> DataFrame:
    """Records, poison recall and strict attack success by dataset, defense and k; for complete or update mode."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    return records.groupBy("dataset", "defense", "k").agg(F.count("*").alias("n"), F.avg("poison_recall").alias("mean_poison_recall"), share("asr_with_defense").alias("asr_with_defense"))


def windowed_counts(records: DataFrame, ts: str = "logged_at", size: str = "1 day", late: str = "60 days") -> DataFrame:
    """Records and removals by event-time window and defense; state older than the watermark is dropped."""
    timed = records.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", size), "defense").agg(F.count("*").alias("n"), F.sum("removed_poison").alias("removed_poison")).select(F.col("window.start").alias("window_start"), "defense", "n", "removed_poison")


def run_to_table(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there into a Parquet table of the shared folder, and reads it.

    complete replaces the table with each batch, append adds to it; state and table live in the shared folder, so the
    query goes on after a loss, and nothing is held in the driver.
    """
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/ragtide-stream-{uuid.uuid4().hex}"
    schema = df.schema
    spark.createDataFrame([], schema).write.parquet(f"{home}/table")  # a stream without a batch is an empty table

    def keep(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{home}/table")

    writer = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{home}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    discard_at_end(spark, home)
    return spark.read.schema(schema).parquet(f"{home}/table")
