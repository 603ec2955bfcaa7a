"""Readers and writers of corpora, runs, result files and diagnostic records. Schemas are given, never inferred."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "_id string, title string, text string"
QUERIES = "_id string, text string"
QRELS = "`query-id` string, `corpus-id` string, score int"
TARGET = "id string, question string, `correct answer` string, `incorrect answer` string, adv_texts array<string>"
RECORD = (
    "id string, question string, injected_adv array<string>, injected_adv_defended array<string>, defense string, input_prompt string, output_poison string, incorrect_answer string, "
    "answer string, input_prompt_no_defense string, output_poison_no_defense string"
)
DIAGNOSTIC = (
    "query_id string, dataset string, model string, attack string, defense string, k int, N_injected int, retrieved_doc_ids array<string>, retrieved_is_poison array<boolean>, N_retrieved_poison int, "
    "N_retrieved_clean int, N_adv_estimated_by_ragdefender int, removed_doc_ids array<string>, removed_is_poison array<boolean>, removed_poison int, removed_clean int, poison_recall double, "
    "clean_false_positive_rate double, residual_poison_count int, residual_clean_count int, residual_poison_fraction double, answer_no_defense string, answer_with_defense string, "
    "target_wrong_answer string, gold_answer string, asr_no_defense boolean, asr_with_defense boolean, asr_no_defense_legacy boolean, asr_with_defense_legacy boolean, asr_no_defense_strict boolean, "
    "asr_with_defense_strict boolean, latency_retrieval_sec double, latency_defense_sec double, latency_generation_sec double, notes string"
)
GENERATED = ("answer_no_defense", "answer_with_defense", "asr_no_defense", "asr_with_defense", "asr_no_defense_legacy", "asr_with_defense_legacy", "asr_no_defense_strict", "asr_with_defense_strict", "latency_generation_sec", "target_wrong_answer", "gold_answer")


def fields(ddl: str) -> list[str]:
    return [part.strip().split(" ")[0].strip("`") for part in ddl.split(", ")]


def missing_fields(df: DataFrame, ddl: str = DIAGNOSTIC) -> list[str]:
    """Fields of a schema that a table lacks, in any case."""
    have = {c.lower() for c in df.columns}
    return [f for f in fields(ddl) if f.lower() not in have]


#: The collections, and the one whose judgements are those of its training part.
COLLECTIONS = ("nq", "msmarco", "hotpotqa")
TRAIN_ONLY = ("msmarco",)


def corpus(spark: SparkSession, folder: str, name: str | None = None, split: str | None = None) -> dict[str, DataFrame]:
    """corpus, queries and qrels of a retrieval collection in its usual layout of JSON lines and tab-separated files.

    With ``name`` (another than the known ones raises) the judgements of one ``split`` (default test; msmarco has those of train only); all there are without it.
    """
    if name is not None and name not in COLLECTIONS:
        raise ValueError(f"no such collection: {name}")
    part = "" if name is None else "/train.tsv" if name in TRAIN_ONLY else f"/{split or 'test'}.tsv"
    return {
        "corpus": spark.read.schema(CORPUS).json(f"{folder}/corpus.jsonl").withColumnRenamed("_id", "doc_id"),
        "queries": spark.read.schema(QUERIES).json(f"{folder}/queries.jsonl").withColumnRenamed("_id", "query_id"),
        "qrels": spark.read.schema(QRELS).option("sep", "\t").option("header", True).csv(f"{folder}/qrels{part}").toDF("query_id", "doc_id", "rel"),
    }


def passages(spark: SparkSession, path: str) -> DataFrame:
    """id, text, title from JSON lines, or from tab-separated text whose header row is left out."""
    if path.endswith(".jsonl"):
        return spark.read.schema("id string, text string, title string").json(path)
    return spark.read.schema("id string, text string, title string").option("sep", "\t").csv(path).where("id <> 'id'")


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files by a given schema; a file holds one value that may span lines, an array gives a row for each element. JSON lines by their ending."""
    return spark.read.schema(schema).option("multiLine", not path.endswith(".jsonl")).json(path)


def run(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, score, rank of a run file {query: {doc: score}}; a file is one value, ranked by score, then doc_id."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,double>>").alias("m"))
    each = whole.select(F.explode("m").alias("query_id", "docs")).select("query_id", F.explode("docs").alias("doc_id", "score"))
    from ragtide.operators.retrieval import compress

    return compress(each, 2**31 - 1)


def targets(spark: SparkSession, path: str) -> DataFrame:
    """position and target of a map {id: target}, in the order of the file."""
    whole = spark.read.text(path, wholetext=True).select(F.map_entries(F.from_json("value", f"map<string,struct<{_nested(TARGET)}>>")).alias("e"))
    return whole.select(F.posexplode("e").alias("position", "x")).select("position", "x.value.*")


def _nested(ddl: str) -> str:
    return ", ".join(f"{p.strip().rsplit(' ', 1)[0]}:{p.strip().rsplit(' ', 1)[1]}" for p in ddl.split(", "))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Flat records of result files, with file, position and iteration; later files and positions of an id can be picked by ``latest``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    kind = f"map<string,array<struct<{_nested(RECORD)}>>>"
    several, single = F.from_json("value", f"array<{kind}>"), F.from_json("value", kind)
    maps = F.when(F.ltrim("value").startswith("["), several).otherwise(F.array(single))
    each = whole.select("file", F.explode(maps).alias("m")).select("file", F.explode("m").alias("iter_name", "records"))
    return each.select("file", "iter_name", F.posexplode("records").alias("position", "r")).select("file", "iter_name", "position", "r.*")


def diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """Diagnostic records of JSON lines by the full schema: fields that older files lack are null, blank lines are left out."""
    return spark.read.schema(DIAGNOSTIC).json(path).where(F.col("query_id").isNotNull())


def dataset_of(file_name: str) -> Column:
    """The dataset that a file's name begins with."""
    return F.substring_index(F.element_at(F.split(file_name, "/"), -1), "-", 1)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, decimals: int = 4) -> None:
    """CSV with a header, floats in fixed decimals and None for null floats."""
    shown = [F.when(F.col(c).isNull(), "None").otherwise(F.format_string(f"%.{decimals}f", c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def read_flag(column: str) -> Column:
    """A boolean that a CSV holds as text."""
    return F.lower(F.trim(column)) == "true"


def write_config(spark: SparkSession, config: dict, path: str, inputs: list[str] | None = None) -> None:
    """A run's configuration and its hash, and the path, length and hash of each input file, as JSON rows."""
    text = json.dumps(config, sort_keys=True)
    rows = spark.createDataFrame([(text,)], "config string").select("config", F.md5("config").alias("md5"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("length"))
    for given in inputs or []:
        files = spark.read.format("binaryFile").load(given).select(F.lit(None).cast("string").alias("config"), F.md5("content").alias("md5"), "path", "length")
        rows = rows.unionByName(files)
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_index(vectors: DataFrame, path: str, id_: str, vector: str, config: dict, parts: int | None = None) -> None:
    """An index of packed vectors: rows by ranges of their id, and a file that says its fields and size."""
    spark = vectors.sparkSession
    kept = vectors.where(F.col(vector).isNotNull()).select(id_, F.col(vector).cast("array<double>").alias(vector))
    (kept.repartitionByRange(parts, id_) if parts else kept.repartitionByRange(id_)).write.mode("overwrite").parquet(f"{path}/vectors")
    size = spark.read.parquet(f"{path}/vectors").agg(F.count("*").alias("rows"), F.max(F.size(vector)).alias("width")).first()
    told = {"id": id_, "vector": vector, "rows": size[0], "width": size[1], **config}
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The vectors of an index and what its file says; other fields than it says raise."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    vectors = spark.read.parquet(f"{path}/vectors")
    if vectors.columns != [about["id"], about["vector"]]:
        raise ValueError(f"the index at {path} has other fields: {vectors.columns}")
    return vectors, about
