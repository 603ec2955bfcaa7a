"""A learned passage filter: label-free features, a group-safe split and a tree ensemble."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ragtide.operators import providers
from ragtide.operators.trees import Trees
from ragtide.sources.tables import drop_shuffles, durable

FEATURES = ("filterrag_score", "query_only_score", "answer_token_overlap_score", "matched_words", "distinct_words", "answer_length", "passage_length", "query_overlap", "retrieval_score", "perplexity", "slm_answer_logprob")
#: Features that are counted from a row's texts.
COUNTED = {"matched_words": IntegerType(), "distinct_words": IntegerType(), "answer_length": IntegerType(), "passage_length": IntegerType(), "query_overlap": DoubleType()}
#: Rows of a fit that a task reads.
TASK_ROWS = 50_000


def safe(x: Column) -> Column:
    """Null, not-a-number and infinite values as 0."""
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(0.0)).otherwise(d)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTED from question, answer and passage in lower case (_q, _a, _p), which are dropped: a passage's tokens are made once, as Spark's patterns take several times as long."""
    words = re.compile("[a-z0-9']+").findall
    for batch in batches:
        made = []
        for q, a, p in zip(*(batch[c].to_pylist() for c in ("_q", "_a", "_p")), strict=True):
            asked, answered, read = words(q), words(a), words(p)
            keys, wanted, distinct = {*asked, *answered}, {*asked}, {*read}
            shared = len(wanted & distinct)
            overlap = shared / (len(wanted) + len(distinct) - shared) if wanted and distinct else 0.0
            made.append((sum(map(keys.__contains__, read)), len(distinct), len(answered), len(read), overlap))
        columns = zip(*made, strict=True) if made else [[]] * len(COUNTED)
        kept = batch.drop_columns(["_q", "_a", "_p"])
        types = [pa.float64() if c == "query_overlap" else pa.int32() for c in COUNTED]
        yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(v, t) for v, t in zip(columns, types, strict=True)]], [*kept.schema.names, *COUNTED])


def features(rows: DataFrame, question: str = "question", answer: str = "slm_answer", passage: str = "text", passages: DataFrame | None = None) -> DataFrame:
    """``rows`` without their passage, with FEATURES as doubles; none reads the label. Perplexity and log-probability are by the stand-in over all distinct passages.

    What needs a passage's text is counted in place, once, and the rows are kept without it; perplexity is worked out for each distinct passage and
    joined by the text's SHA-256. ``passages``: the same passages as those of the rows, if they can be had with fewer copies.
    """
    spark = rows.sparkSession
    corpus = durable((rows if passages is None else passages).select(passage).distinct())
    drop_shuffles(spark)
    model = providers.unigram(corpus, passage)
    scored = providers.corpus_perplexity(corpus, passage, model).withColumnRenamed("_digest", "_passage")
    low = [F.lower(F.coalesce(c, F.lit(""))).alias(n) for c, n in ((question, "_q"), (answer, "_a"), (passage, "_p"))]
    read = rows.select(*[c for c in rows.columns if c != passage], F.unhex(F.sha2(passage, 256)).alias("_passage"), *low)
    kept = StructType([f for f in read.schema if f.name not in ("_q", "_a", "_p")])
    light = durable(read.mapInArrow(_counted, StructType([*kept, *[StructField(c, t) for c, t in COUNTED.items()]])))
    drop_shuffles(spark)
    answered = providers.unigram_logprob(providers.noted(light, "perplexity: unigram proxy"), answer, corpus, passage, model)
    got = answered.join(scored, "_passage", "left").drop("_passage").withColumn("perplexity", F.coalesce("perplexity", F.lit(1.0)))
    return got.withColumns({c: safe(F.col(c)) for c in FEATURES})


def model_kind(dataset: str) -> str:
    """The ensemble for a dataset: a forest for hotpotqa and msmarco, boosted trees for nq."""
    kinds = {"hotpotqa": "forest", "msmarco": "forest", "nq": "boosted"}
    if dataset not in kinds:
        raise ValueError(f"no model kind is set for dataset {dataset}")
    return kinds[dataset]


def fit(labelled: DataFrame, label: str = "is_poison", kind: str = "forest", seed: int = 12, trees: int = 100) -> PipelineModel:
    """A fitted pipeline from FEATURES to probability, over all rows with a label.

    A forest's trees grow until their leaves are pure or at 30 levels; boosted trees have the defaults of XGBoost (depth 6, rate 0.3).
    """
    missing = [c for c in FEATURES if c not in labelled.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    rows = labelled.where(F.col(label).isNotNull()).select(*FEATURES, F.col(label).cast("double").alias("label"))
    total = rows.count()
    if not total:
        raise ValueError("no rows with a label")
    rows = rows.coalesce(-(-total // TASK_ROWS))
    return Pipeline(stages=[Trees(kind=kind, numTrees=trees, maxDepth=30 if kind == "forest" else 6, seed=seed, inputCols=list(FEATURES))]).fit(rows)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the probability of class 1."""
    return model.transform(rows)


#: What the file beside a saved model must hold.
ARTIFACT = ("model_type", "feature_names", "threshold_default", "training_meta")


def save(model: PipelineModel, path: str, spark: SparkSession, kind: str, meta: dict[str, object], threshold: float = 0.5) -> None:
    """The model and, beside it, a file that says what it is: kind, features in order, default threshold, how it was trained."""
    model.write().overwrite().save(f"{path}/model")
    told = {"model_type": kind, "feature_names": list(FEATURES), "threshold_default": threshold, "training_meta": meta}
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(path: str, spark: SparkSession) -> tuple[PipelineModel, dict[str, object]]:
    """A saved model and what its file says. An empty path, a missing file, a file that lacks a key or has other features raises."""
    if not path:
        raise ValueError("a model path is needed")
    try:
        rows = spark.read.text(f"{path}/about").limit(2).collect()
    except AnalysisException as e:
        raise FileNotFoundError(f"no model at {path}") from e
    about = json.loads(rows[0][0]) if len(rows) == 1 else {}
    missing = [k for k in ARTIFACT if k not in about] if isinstance(about, dict) else list(ARTIFACT)
    if missing:
        raise ValueError(f"the model at {path} does not say its {', '.join(missing)}")
    if list(about["feature_names"]) != list(FEATURES):
        raise ValueError(f"the model at {path} has other features: {about['feature_names']}")
    return PipelineModel.load(f"{path}/model"), about


def fit_and_score(rows: DataFrame, kind: str | None = None, label: str = "is_poison") -> DataFrame:
    """The test rows of ``rows`` (FEATURES, dataset, split) with the probability by a model of their own dataset, fitted on its training rows.

    The ensemble is ``kind``, or by ``model_kind``. Where all training rows are of one class the probability is that class; null where a dataset has none.
    """
    rows = durable(rows)
    drop_shuffles(rows.sparkSession)
    classes: dict[str, list[bool]] = {r[0]: r[1] for r in rows.groupBy("dataset").agg(F.collect_set(F.when(F.col("split") == "train", F.col(label)))).collect()}  # one row a dataset

    def one(dataset: str) -> DataFrame:
        own, seen = rows.where(F.col("dataset") == dataset), classes[dataset]
        test = own.where("split = 'test'")
        if len(seen) < 2:
            return test.withColumn("probability", F.lit(float(seen[0]) if seen else None).cast("double"))
        return durable(score(fit(own.where("split = 'train'"), label, kinds[dataset]), test))

    kinds = {dataset: kind or model_kind(dataset) for dataset in classes}
    with ThreadPoolExecutor(3) as pool:  # the fits of a few datasets run side by side
        return reduce(DataFrame.unionByName, pool.map(one, sorted(classes)), rows.where("false").withColumn("probability", F.lit(None).cast("double")))
