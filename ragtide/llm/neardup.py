"""Exact set-similarity join of texts on their words, by token-combination prefixes.

Texts of equal word sets are one class. Tokens have one global order, rare before frequent, by counts in a table
of fixed size (a hash of the token picks its cell), so nothing that grows with the vocabulary is broadcast. Two
sets of Jaccard similarity s >= t share at least k tokens among the first |x| - ceil(t |x|) + k tokens of each.
So, with c1, c2, c3 the first tokens that both share: if c1 is rare, both are indexed under c1; else, the order
being by frequency, c2 is not rare either, and both are indexed under (c1, c2); where c1 is of the most frequent
class, under (c1, c2, c3). Candidates of a common key are pruned by size and by a 256-bit bitmap whose
difference bounds the overlap, then verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.sources.tables import durable, release, spread

CELLS = 1 << 16
#: Sets that hold a token of a cell: up to RARE it is indexed alone, up to COMMON in pairs, beyond in triples.
RARE, COMMON = 64, 4096
WORDS = "[a-z0-9']+"


def word_sets(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key and tokens (sorted distinct 64-bit hashes of the words) of each row; rows without words are left out."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORDS), F.lit(0)))
    return texts.select(key, words.alias("_w")).where(F.size("_w") > 0).select(key, F.array_sort(F.array_distinct(F.transform("_w", lambda w: F.xxhash64(w)))).alias("tokens"))


def _signatures(counts: np.ndarray, threshold: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = np.asarray(batch.column(0)), batch.column(1)
            flat, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets)
            ends = ends - ends[0]
            n = np.diff(ends)
            owner = np.repeat(np.arange(len(ids)), n)
            mixed = flat.view(np.uint64)
            weight = counts[(mixed % np.uint64(CELLS)).astype(np.int64)]
            order = np.lexsort((flat, weight, owner))
            token, weight = mixed[order], weight[order]
            place = np.arange(len(flat)) - np.repeat(ends[:-1], n)
            bits = np.zeros((len(ids), 4), np.uint64)
            spot = (mixed >> np.uint64(40)) & np.uint64(255)
            np.bitwise_xor.at(bits, (owner, (spot >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (spot & np.uint64(63)))
            first = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            own: list[np.ndarray] = []
            keys: list[np.ndarray] = []

            def put(rows: np.ndarray, *parts: np.ndarray, own: list = own, keys: list = keys) -> None:
                h = np.full(len(rows), len(parts), np.uint64)
                for p in parts:
                    h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                own.append(rows)
                keys.append(h)

            head = place < first[owner]
            single = head & (weight <= RARE)
            put(owner[single], token[single])
            # combinations: gaps between positions run over the extended prefix, a few dozen steps whatever the data
            lead = np.flatnonzero(head & (weight > RARE))
            size = len(flat)
            widest = int(first.max()) + 2 if len(first) else 0
            for a in range(1, widest):
                if not len(lead):
                    break
                j = lead + a
                ok = (j < size) & (place[lead] + a < np.minimum(first + 1, n)[owner[lead]])
                i, j = lead[ok], j[ok]
                two = weight[i] <= COMMON
                put(owner[i[two]], token[i[two]], token[j[two]])
            top = lead[weight[lead] > COMMON]
            for a in range(1, widest + 1):
                j = top + a
                ok = (j < size) & (place[top] + a < np.minimum(first + 1, n)[owner[top]])
                i, j = top[ok], j[ok]
                if not len(i):
                    break
                for b in range(1, widest + 1):
                    k = j + b
                    also = (k < size) & (place[j] + b < np.minimum(first + 2, n)[owner[j]])
                    if not also.any():
                        break
                    put(owner[i[also]], token[i[also]], token[j[also]], token[k[also]])
            rows, key = np.concatenate(own), np.concatenate(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ids[rows]), pa.array(n[rows].astype(np.int32)), *(pa.array(bits[rows, w].view(np.int64)) for w in range(4))], ["key", "id", "n", "b0", "b1", "b2", "b3"]
            )

    return run


def similar_sets(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs a < b of ids of distinct sets (id bigint, tokens) whose Jaccard similarity is at least ``threshold``, with it.

    Exact: every pair is found and none that is less similar. A hot combination is no group of one task: its
    members meet in a shuffled join that AQE splits, and the size and bitmap bounds drop most pairs before they are moved on.
    """
    if threshold < 0.75:
        raise ValueError("below 0.75 different sets may share fewer than three tokens, which triples cannot index")
    spark = sets.sparkSession
    cell = F.expr(f"cast(pmod(t, {CELLS}) as int)")
    got = sets.select(F.explode("tokens").alias("t")).groupBy(cell.alias("c")).agg(F.count("*").alias("m")).collect()  # at most CELLS rows
    counts = np.zeros(CELLS, np.int64)
    for r in got:
        counts[r[0]] = r[1]
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _signatures(shared.value, threshold)(batches)

    signed = spread(sets.select("id", "tokens")).mapInArrow(run, "key bigint, id bigint, n int, b0 bigint, b1 bigint, b2 bigint, b3 bigint")
    x, y = signed.alias("x"), signed.alias("y")
    differ = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(1, 4)), F.bit_count(F.col("x.b0").bitwiseXOR(F.col("y.b0"))))
    total = F.col("x.n") + F.col("y.n")
    # |x and y| >= t/(1+t) (|x|+|y|), and the bitmaps differ in no more bits than the sets in tokens
    bound = total - 2 * F.ceil(F.lit(threshold / (1 + threshold)) * total - 1e-9)
    near = x.join(y, F.expr("x.key = y.key and x.id < y.id")).where((F.least("x.n", "y.n") >= F.lit(threshold) * F.greatest("x.n", "y.n") - 1e-9) & (differ <= bound))
    pairs = near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("_x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("_y")), "b")
    common = F.size(F.array_intersect("_x", "_y"))
    ratio = common / (F.size("_x") + F.size("_y") - common)
    return both.select("a", "b", ratio.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def text_classes(texts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(sets: id, tokens; members: ``key``, id): the distinct word sets of all texts and which rows hold them.

    ``key`` may hold a set more than once; members are distinct. id is a 64-bit hash of the sorted tokens, so texts of
    equal word sets meet before anything is compared. Durable: both are read several times.
    """
    held = word_sets(texts, key, text).withColumn("id", F.xxhash64("tokens"))
    sets = durable(held.groupBy("id").agg(F.first("tokens").alias("tokens")))
    members = durable(held.select(key, "id").distinct())
    return sets, members


def similar_records(texts: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """Pairs (record_a < record_b) of keys that hold alike texts, once each; every pair, also of copies."""
    sets, members = text_classes(texts, key, text)
    links = similar_sets(sets, threshold).select("a", "b")
    a, b = members.select(F.col(key).alias("_ka"), F.col("id").alias("a")), members.select(F.col(key).alias("_kb"), F.col("id").alias("b"))
    apart = links.join(a, "a").join(b, "b").where("_ka <> _kb").select(F.least("_ka", "_kb").alias("record_a"), F.greatest("_ka", "_kb").alias("record_b"))
    shared = members.groupBy("id").agg(F.count("*").alias("_m")).where("_m > 1").select("id")
    same = members.join(shared, "id", "left_semi")
    copies = same.select("id", F.col(key).alias("record_a")).join(same.select("id", F.col(key).alias("record_b")), "id").where("record_a < record_b").select("record_a", "record_b")
    return apart.unionByName(copies).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of ``edges`` (u, v) the least node that it is linked with, by large-star and small-star rounds.

    Every round is one aggregation over the edges, written to the shared folder; nothing is gathered on the driver. A hub's
    neighbours are never in one row: its minimum is an aggregate that is joined back.
    """
    both = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, before = durable(both), None
    while True:
        around = current.select("u", "v").unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = durable(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        done, current = current, durable(small)
        release(done)
        release(large)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def record_groups(texts: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """One row for each key with texts: ``key``, group_id (the least key that it is linked with, over any number of links) and n_links,
    its links between different word sets. Keys without alike texts are groups of their own; rows without words are left out."""
    sets, members = text_classes(texts, key, text)
    links = durable(similar_sets(sets, threshold).select("a", "b"))
    heads = members.groupBy("id").agg(F.min(key).alias("_head"))
    star = members.join(heads, "id").select(F.col(key).alias("u"), F.col("_head").alias("v"))
    across = links.join(heads.select(F.col("id").alias("a"), F.col("_head").alias("u")), "a").join(heads.select(F.col("id").alias("b"), F.col("_head").alias("v")), "b").select("u", "v")
    roots = components(star.unionByName(across))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("_d"))
    linked = members.join(degree, "id", "left").groupBy(key).agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("n_links"))
    return linked.join(roots.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("root", F.col(key)).alias("group_id"), "n_links")
