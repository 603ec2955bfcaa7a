"""Vector search of a query set against all rows, merging of injected passages, and what follows from ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ragtide.functions import vectors as V
from ragtide.sources.tables import spread

#: Vectors in a packed block of rows, and in one of queries.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Bytes of packed queries up to which they are broadcast; beyond, blocks meet in a Cartesian product of partitions.
BROADCAST_BYTES = 32 << 20


def _packed(df: DataFrame, id_: str, vector: str, name: str, size: int) -> DataFrame:
    """Rows of up to ``size`` ids (name_ids) and their vectors as one buffer of doubles (name_v), packed where they lie: nothing is shuffled."""
    schema = pa.schema([(f"{name}_ids", pa.list_(to_arrow_type(df.schema[id_].dataType))), (f"{name}_v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                vectors = part.column(1)
                flat = vectors.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
                if len(flat) % part.num_rows or len(set(vectors.value_lengths().to_pylist())) > 1:
                    raise ValueError("vectors of different lengths")
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids.cast(schema.field(0).type), pa.array([flat.tobytes()], pa.binary())], schema=schema)

    given = df.where(F.col(vector).isNotNull()).select(F.col(id_).alias("_id"), V.doubles(F.col(vector)).alias("_v"))
    return given.mapInArrow(run, f"{name}_ids array<{df.schema[id_].dataType.simpleString()}>, {name}_v binary")


def _best(q: np.ndarray, c: np.ndarray, k: int, metric: str, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, score) of the k best of ``c`` for each of ``q``, and of all that tie with the last; ``own`` marks pairs left out."""
    if metric == "cosine":
        q, c = (m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1) for m in (q, c))
    scores = q @ c.T
    if own is not None:
        scores[own] = -np.inf
    scores[np.isnan(scores)] = -np.inf
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k, None]
        i, j = np.nonzero((scores >= least - 1e-9) & np.isfinite(scores))
    else:
        i, j = np.nonzero(np.isfinite(scores))
    return i, j, scores[i, j]


def top_k(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", query: str = "query_id", doc: str = "doc_id", vector: str = "embedding", skip_self: bool = False) -> DataFrame:
    """(query, doc, score, rank from 0): the k best rows of ``corpus`` for each query, exact; ties (to nine decimals) by doc.

    The query set meets all rows in packed blocks (BLOCK rows, QUERY_BLOCK queries): one matrix product and one partial top k
    for a pair of blocks, in flat buffers, so no pair of rows is ever a row of its own, and the last ranking sorts about k rows
    a block, of which Spark keeps k before the shuffle. Packed queries are broadcast up to BROADCAST_BYTES (counted first) and meet
    the blocks partition by partition beyond. Null vectors are left out; vectors without length score 0 by cosine, such with nulls
    or NaN inside are found by nothing; an empty side gives no rows. ``skip_self``: a row is no result of a query of its own id.
    """
    q = _packed(queries, query, vector, "q", QUERY_BLOCK)
    c = _packed(spread(corpus), doc, vector, "c", BLOCK)
    width = queries.where(F.col(vector).isNotNull()).agg(F.count("*"), F.max(F.size(vector))).first()
    if width[0] * (width[1] or 0) * 8 <= BROADCAST_BYTES:
        q = F.broadcast(q)
    kinds = queries.schema[query].dataType, corpus.schema[doc].dataType
    schema = pa.schema([(query, to_arrow_type(kinds[0])), (doc, to_arrow_type(kinds[1])), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                docs, left = batch.column(0)[r].values, batch.column(2)[r].values
                x, y = (np.frombuffer(batch.column(at)[r].as_buffer(), np.float64).reshape(n, -1) for at, n in ((3, len(left)), (1, len(docs))))
                own = None
                if skip_self:
                    codes = pa.concat_arrays([left.cast(docs.type), docs]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                    own = codes[: len(left), None] == codes[None, len(left) :]
                i, j, score = _best(x, y, k, metric, own)
                yield pa.RecordBatch.from_arrays([left.take(pa.array(i)), docs.take(pa.array(j)), pa.array(score)], schema=schema)

    found = c.crossJoin(q).mapInArrow(run, f"{query} {kinds[0].simpleString()}, {doc} {kinds[1].simpleString()}, score double")
    order = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), doc)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank") - 1)


def injected_vectors(vectors: DataFrame, group: int = 50, every: int = 10, weight: float = 0.6) -> DataFrame:
    """Vectors labelled as injected: each query (ids divisible by ``group``) owns the ids of its group that leave 1 by ``every``.

    An injected vector is the unit vector of weight * query + sqrt(1 - weight²) * own vector; id adv::query::n.
    """
    ids = F.col("vec_id")
    pool = vectors.where(ids % every == 1).select((F.floor(ids / group) * group).alias("query_id"), (F.floor((ids % group) / every)).alias("n"), V.doubles(F.col("embedding")).alias("_p"))
    queries = vectors.where(ids % group == 0).select(ids.alias("query_id"), V.doubles(F.col("embedding")).alias("_q"))
    mixed = V.unit(V.mix(F.col("_q"), F.col("_p"), F.lit(weight), F.lit((1 - weight**2) ** 0.5)))
    return pool.join(queries, "query_id").select(F.concat_ws("::", F.lit("adv"), F.col("query_id").cast("string"), F.col("n").cast("string")).alias("doc_id"), F.col("query_id").alias("owner"), mixed.alias("embedding"))


def merged_top_k(vectors: DataFrame, k: int) -> DataFrame:
    """The top k of corpus and injected rows for each query, labelled: query_id, doc_id, source, is_poison, own (of this query's group), score, rank, embedding."""
    corpus = vectors.select(F.col("vec_id").cast("string").alias("doc_id"), F.lit(None).cast("bigint").alias("owner"), V.doubles(F.col("embedding")).alias("embedding"))
    both = corpus.unionByName(injected_vectors(vectors))
    queries = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    found = top_k(queries, both, k, skip_self=True)
    poison = F.col("owner").isNotNull()
    return found.join(both, "doc_id").select(
        F.col("query_id").cast("bigint").alias("query_id"), "doc_id", F.when(poison, "adversarial").otherwise("corpus").alias("source"), poison.alias("is_poison"),
        F.coalesce(F.col("owner") == F.col("query_id").cast("bigint"), F.lit(False)).alias("own"), F.col("score"), F.col("rank"), "embedding",
    )


def prefix_grid(ranked: DataFrame, ks: list[int]) -> DataFrame:
    """Counts of the first k rows for every k of ``ks``: one ranking, explode to the prefixes that hold a row."""
    held = ranked.select("query_id", "is_poison", "own", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k > F.col("rank"))).alias("k"))
    return held.groupBy("query_id", "k").agg(F.count_if("is_poison").alias("n_poison"), F.count_if(~F.col("is_poison")).alias("n_clean"), F.count_if("own").alias("own_hits"))


def compress(run: DataFrame, most: int = 2000) -> DataFrame:
    """The ``most`` best rows of a retrieval run for each query, ranked again."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return run.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < most)


def hash_candidates(queries: DataFrame, vectors: DataFrame, tables: int = 40, bits: int = 5, seed: int = 3) -> DataFrame:
    """query_id, doc_id of all pairs that lie on the same side of all ``bits`` random hyperplanes of one of the ``tables``, each pair once. Both sides: an id and embedding."""

    def keys(df: DataFrame, name: str) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    x = np.array(f["embedding"].tolist(), np.float64)
                    planes = np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits))
                    codes = ((x @ planes > 0).reshape(len(x), tables, bits) << np.arange(bits)).sum(2) + (np.arange(tables) << bits)
                    yield pd.DataFrame({name: f[name], "_key": list(codes)})

        kind = df.schema[name].dataType.simpleString()
        given = df.where("embedding is not null").select(name, V.doubles(F.col("embedding")).alias("embedding"))
        return given.mapInPandas(run, f"{name} {kind}, _key array<bigint>").select(name, F.explode("_key").alias("_key"))

    return keys(queries, "query_id").join(keys(vectors, "doc_id"), "_key").select("query_id", "doc_id").distinct()


def hashed_top_k(queries: DataFrame, vectors: DataFrame, k: int, tables: int = 40, bits: int = 5, seed: int = 3) -> DataFrame:
    """The nearest ``k`` of each query's candidates, itself left out: query_id, doc_id, distance (of the unit vectors), rank. There is no limit of distance."""
    found = hash_candidates(queries, vectors, tables, bits, seed).where("query_id <> doc_id")
    unit = V.unit(V.doubles(F.col("embedding")))
    near = found.join(queries.select("query_id", unit.alias("_a")), "query_id").join(vectors.select("doc_id", unit.alias("_b")), "doc_id")
    near = near.select("query_id", "doc_id", V.norm(V.mix(F.col("_a"), F.col("_b"), F.lit(1.0), F.lit(-1.0))).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return near.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
