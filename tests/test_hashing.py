from pyspark.sql import functions as F

from ragtide.operators import retrieval
from ragtide.plans import catalogue


def test_far_neighbours_are_ranked_too(spark, tmp_path):
    basis = spark.range(60).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i == F.col("id")).cast("float")).alias("embedding"))
    basis.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.QUERIES["lsh_topk"](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, i) for q in (0, 50) for i in range(10)]
    assert {r.distance for r in got} == {1.414214}


def test_hashing_leaves_pairs_out(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding")
    queries, docs = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "doc_id")
    pairs = retrieval.hash_candidates(queries, docs)
    n = pairs.count()
    assert n == pairs.distinct().count()
    assert n < 0.8 * queries.count() * docs.count()
