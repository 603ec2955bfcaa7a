"""Token ids and token counts of whole documents by a public byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm.bytebpe import ByteBpe
from ragtide.sources.tables import spread

#: The vocabulary file; another place can be given to every operator.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"


@cache
def encoder(path: str) -> ByteBpe:
    """The encoder of a vocabulary file, built once on the driver and broadcast (about 5 MB, fixed by the vocabulary)."""
    return ByteBpe(path)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def encode_column(df: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K, into: str = "ids") -> DataFrame:
    """``key`` and the token ids of ``text`` for every row.

    Ids are those of the vocabulary without special tokens; strings that look like special tokens are ordinary
    text. Null and empty texts get an empty list. Repeated rows and null keys stay as they are; other columns
    are not read. One narrow pass, no shuffle (a table of fewer files than cores is spread first).
    """
    shared = df.sparkSession.sparkContext.broadcast(encoder(path))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = shared.value.encode(_column(batch, "_text"))
            ends = counts.cumsum()
            offsets = pa.array([0, *ends.tolist()], pa.int32()) if len(ends) else pa.array([0], pa.int32())
            yield pa.RecordBatch.from_arrays([_column(batch, "_key"), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["_key", "_ids"])

    got = spread(df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))).mapInArrow(run, f"_key {kind.simpleString()}, _ids array<int>")
    return got.select(F.col("_key").alias(key), F.col("_ids").alias(into))


def token_counts(df: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K, into: str = "n_tokens") -> DataFrame:
    """``key`` and the number of tokens of ``text`` (0 for null and empty texts), by the encoder of encode_column."""
    shared = df.sparkSession.sparkContext.broadcast(encoder(path))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_column(batch, "_key"), pa.array(shared.value.encode(_column(batch, "_text"))[1])], ["_key", "_n"])

    got = spread(df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))).mapInArrow(run, f"_key {kind.simpleString()}, _n bigint")
    return got.select(F.col("_key").alias(key), F.col("_n").alias(into))
