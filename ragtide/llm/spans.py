"""Long spans that occur, character for character, in texts of more than one record.

Every window of ``length`` characters holds the seed that a minimum over its k-grams picks, wherever the window
occurs. Seeds of one record alone are dropped by an aggregate; around the others the text is cut out to the
reach of a window (at most 2 length - k characters), and equal cuts of a seed become one. Shards of seeds, each with all cuts of its
seeds, get a compressed FM-index; every cut is streamed against its shard, and backward search gives the
first and the last window that a cut of another record holds. As all windows of a cut share the seed, what lies
between is shared too. Seeds with more distinct cuts than one index should hold are resolved by window hashes instead, which
spread over the cluster whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtide.llm.fmindex import shared_ranges
from ragtide.sources.tables import durable, spread

#: Distinct cuts of one seed up to which they are indexed together.
HOT = 4000
#: Characters in a shard, about.
SHARD = 1_000_000
#: Characters that are searched for seeds at once.
PIECE = 1 << 20
PRIME = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, PRIME, np.uint64), np.full(n, pow(PRIME, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sliding(x: np.ndarray, w: int, take: np.ufunc, pad: int) -> np.ndarray:
    """take over x[i : i + w] for every i, in two passes over blocks of w."""
    n = len(x)
    full = np.concatenate([x, np.full((-n) % w + w, pad, x.dtype)]).reshape(-1, w)
    ahead = take.accumulate(full, axis=1).ravel()
    back = take.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(back[:n], ahead[w - 1 : w - 1 + n])


def seeds_of(texts: list[str], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, 64-bit seed) of every seed; texts shorter than ``length`` have none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n, w = len(points), length - k + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    up, down = _powers(n)
    total = np.concatenate([[np.uint64(0)], np.cumsum((points + np.uint64(1)) * up, dtype=np.uint64)])
    gram = (total[k:] - total[:-k]) * down[: n - k + 1]
    gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    gram = (gram ^ (gram >> np.uint64(29))) | np.uint64(1)
    least = _sliding(gram, w, np.minimum, 2**64 - 1)[: n - length + 1]  # of the window of w grams at each place
    begin = np.cumsum(sizes) - sizes
    text_of = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(n) - begin[text_of]
    least = np.where(place[: n - length + 1] + length <= sizes[text_of[: n - length + 1]], least, np.uint64(0))  # no window over two texts
    most = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, np.maximum, 0)[: n - k + 1]
    at = np.flatnonzero(most == gram)
    return text_of[at], place[at], gram[at].view(np.int64)


def _seed_table(texts: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces: list[str] = []
            owner: list[int] = []
            offset: list[int] = []
            size = 0
            for i, text in enumerate(batch.column(2)):
                value = text.as_py()
                for begin in range(0, max(1, len(value) - length + 1), PIECE):  # every window of a long text lies in one of its pieces
                    pieces.append(value[begin : begin + PIECE + length - 1])
                    owner.append(i)
                    offset.append(begin)
                    size += len(pieces[-1])
                    if size >= PIECE:
                        yield seeded(batch, pieces, owner, offset)
                        pieces, owner, offset, size = [], [], [], 0
            if pieces:
                yield seeded(batch, pieces, owner, offset)

    def seeded(batch: pa.RecordBatch, pieces: list[str], owner: list[int], offset: list[int]) -> pa.RecordBatch:
        which, at, seed = seeds_of(pieces, length, k)
        index = pa.array(np.array(owner, np.int64)[which])
        at = at + np.array(offset, np.int64)[which]
        return pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(at.astype(np.int32)), pa.array(seed)], ["row", "rec", "pos", "seed"])

    return texts.select("row", "rec", "text").mapInArrow(run, "row bigint, rec bigint, pos int, seed bigint")


def shared_spans(texts: DataFrame, length: int = 150, k: int = 50, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """Maximal stretches of characters that lie in a span of ``length`` that another record's text holds too.

    ``texts``: record_id bigint, field, item, base (where the text begins in its value), text. Returns record_id, field, item,
    span_start, span_end (in the value), one row for each longest unbroken stretch, in code points. Null and empty texts, and
    such shorter than ``length``, share nothing. Rows of one record_id are one record (null is one record of its own), so a
    copy within a record is not shared; repeated rows give their stretches once. Windows are compared exactly by the index;
    for hot seeds by two 64-bit hashes.
    """
    reach = length - k
    kept = texts.where(F.length("text") >= length)
    rec = F.coalesce(F.col("record_id"), F.lit(-(2**63)))
    rows = durable(spread(kept).select(F.monotonically_increasing_id().alias("row"), rec.alias("rec"), "record_id", "field", "item", F.col("base").cast("bigint").alias("base"), "text"))
    seeds = durable(_seed_table(rows, length, k))
    repeated = seeds.groupBy("seed").agg(F.min("rec").alias("a"), F.max("rec").alias("b")).where("a <> b").select("seed")
    found = seeds.join(repeated, "seed", "left_semi").select("row", "pos", "seed")
    left = F.least(F.col("pos"), F.lit(reach))
    cut = F.substring("text", F.col("pos") - left + 1, left + length)
    occurrences = durable(
        found.join(rows, "row").select("row", "rec", "record_id", "field", "item", (F.col("base") + F.col("pos") - left).alias("at"), "seed", cut.alias("cut")).withColumn("cut_id", F.xxhash64("cut"))
    )
    distinct = durable(occurrences.groupBy("seed", "cut_id").agg(F.min("rec").alias("a"), F.max("rec").alias("b"), F.first("cut").alias("cut")))
    sizes = distinct.groupBy("seed").agg(F.count("*").alias("cuts"), F.sum(F.length("cut")).alias("chars"))
    total = sizes.agg(F.sum("chars")).first()[0] or 0
    shards = max(1, int(total // shard) + 1)
    wide = sizes.where(F.col("cuts") > hot).select("seed")
    indexed = distinct.join(wide, "seed", "left_anti")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        f = pd.concat(parts, ignore_index=True)  # one shard
        cuts, a, b = f["cut"].tolist(), f["a"].to_numpy(), f["b"].to_numpy()
        twice = np.flatnonzero(a != b)  # a cut of several records is indexed for two of them, so each finds the other's
        _, owner = np.unique(np.concatenate([a, b[twice]]), return_inverse=True)
        seeds = f["seed"].to_numpy()
        lo, hi = shared_ranges(cuts + [cuts[i] for i in twice], owner, np.arange(len(f)), length, np.concatenate([seeds, seeds[twice]]))
        yield pd.DataFrame({"seed": f["seed"], "cut_id": f["cut_id"], "lo": lo, "hi": hi})[lo >= 0]

    result = "seed bigint, cut_id bigint, lo bigint, hi bigint"
    # a shard is a range of hashed seeds: as many cuts as another one, and all cuts of its seeds
    dealt = indexed.select("seed", "cut_id", "a", "b", "cut").repartitionByRange(shards, F.xxhash64("seed"))
    searched = dealt.mapInPandas(search, result)
    # hot seeds: every window of their cuts by hash; records counted by an aggregate that combines before the shuffle
    windows = distinct.join(wide, "seed", "left_semi").select("seed", "cut_id", "a", "b", "cut", F.explode(F.sequence(F.lit(0), F.length("cut") - length)).alias("o"))
    piece = F.substring("cut", F.col("o") + 1, F.lit(length))
    windows = windows.select("seed", "cut_id", "a", "b", "o", F.xxhash64(piece).alias("h1"), F.xxhash64(F.lit(7), F.reverse(piece)).alias("h2"))
    foreign = windows.groupBy("seed", "h1", "h2").agg(F.min("a").alias("x"), F.max("b").alias("y")).where("x <> y").select("seed", "h1", "h2")
    hashed = windows.join(foreign, ["seed", "h1", "h2"], "left_semi").groupBy("seed", "cut_id").agg(F.min("o").cast("bigint").alias("lo"), (F.max("o") + length).cast("bigint").alias("hi"))
    ranges = searched.unionByName(hashed).groupBy("seed", "cut_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = occurrences.join(ranges, ["seed", "cut_id"]).select("rec", "record_id", "field", "item", (F.col("at") + F.col("lo")).alias("s"), (F.col("at") + F.col("hi")).alias("e"))
    text = Window.partitionBy("rec", "field", "item").orderBy("s", "e")
    spans = spans.withColumn("_far", F.max("e").over(text.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("_part", F.sum(F.when(F.col("_far") >= F.col("s"), 0).otherwise(1)).over(text.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("rec", "record_id", "field", "item", "_part").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).select("record_id", "field", "item", "span_start", "span_end")


def shared_share(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """For each record: its characters, those that are shared, and their share (null where it has no text)."""
    size = texts.groupBy("record_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    held = spans.groupBy("record_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("spans"))
    got = size.join(held, "record_id", "left")
    shared = F.coalesce("shared_chars", F.lit(0))
    return got.select("record_id", "chars", shared.alias("shared_chars"), F.coalesce("spans", F.lit(0)).alias("spans"), F.try_divide(shared, "chars").alias("share"))
