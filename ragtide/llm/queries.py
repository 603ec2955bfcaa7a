"""Queries of this subpackage over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtide.llm import answers, neardup, packing, quality, spans, tokens
from ragtide.sources.tables import table


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    """field, row_id, value, question, names: the outputs of records with what they answer."""
    records = table(spark, d, "records").select("record_id", "run_id", "question", "answer", "incorrect_answer", "output_poison", "output_poison_no_defense")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("output_poison", "output_poison_no_defense")])
    return records.select("run_id", F.col("record_id").alias("row_id"), "question", F.array("answer", "incorrect_answer").alias("names"), F.inline(fields)).where("value is not null")


def _defended(spark: SparkSession, d: str) -> DataFrame:
    """The answers of diagnostics, each diag_id once, with the question of their record."""
    rows = table(spark, d, "diagnostics").select("diag_id", "record_id", "answer_with_defense", "target_wrong_answer", "gold_answer").where("answer_with_defense is not null").distinct()
    records = table(spark, d, "records").select("record_id", "question", "answer", "incorrect_answer")
    names = F.array_distinct(F.array("answer", "incorrect_answer", "target_wrong_answer", "gold_answer"))
    return rows.join(records, "record_id", "left").select(F.lit(None).cast("bigint").alias("run_id"), F.col("diag_id").alias("row_id"), "question", names.alias("names"), F.lit("answer_with_defense").alias("field"), F.col("answer_with_defense").alias("value"))


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    return answers.classify(_outputs(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).where("defect = 'truncated'").select(F.col("row_id").alias("record_id"), "field").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """For each model: answers, cut answers, those of them that longer copies show, and the share of cut ones."""
    runs = table(spark, d, "runs").select("run_id", "model")
    cut = F.col("defect") == "truncated"
    judged = _cuts(spark, d).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(cut).alias("cut"), F.count_if(cut & (F.col("by") == "prefix")).alias("by_prefix"))
    got = judged.join(runs, "run_id", "left").groupBy("model").agg(F.sum("n").alias("answers"), F.sum("cut").alias("truncated"), F.sum("by_prefix").alias("by_prefix"))
    return got.withColumn("share", F.round(F.try_divide("truncated", "answers"), 6))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Judged answers of prompts and of diagnostics; outputs without defense only lend their sentences."""
    both = _outputs(spark, d).withColumn("judged", F.col("field") == "output_poison").unionByName(_defended(spark, d).withColumn("judged", F.lit(True)))
    return answers.classify(both)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("defect is not null").groupBy("field", "row_id").agg(F.min("defect").alias("defect"))


def p3_types(spark: SparkSession, d: str) -> DataFrame:
    """Every defect type that an answer triggers, a row each; place 0 is the one of p3_found unless it only begins with the question."""
    return _pairs(spark, d).select("field", "row_id", F.posexplode("defects").alias("place", "defect")).distinct()


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """For each field and defect the number of answers."""
    return p3_found(spark, d).groupBy("field", "defect").agg(F.count("*").alias("answers"))


#: What stands before and after the contexts of a prompt.
BEFORE, AFTER = "\n\nContexts: ", " \n\nQuery: "


def _record_texts(spark: SparkSession, d: str) -> DataFrame:
    """record_id, field, item, base, text: the question, each injected text, and the contexts of the prompt."""
    records = table(spark, d, "records").select("record_id", "question", "injected_adv", "input_prompt")
    zero = F.lit(0).cast("bigint")
    start = F.instr("input_prompt", BEFORE) - 1 + len(BEFORE)
    end = F.length("input_prompt") - F.length(F.substring_index("input_prompt", AFTER, -1)) - len(AFTER)
    question = F.array(F.struct(F.lit("question").alias("field"), zero.alias("item"), zero.alias("base"), F.col("question").alias("text")))
    injected = F.transform(F.coalesce("injected_adv", F.array().cast("array<string>")), lambda t, i: F.struct(F.lit("injected_adv").alias("field"), i.cast("bigint").alias("item"), zero.alias("base"), t.alias("text")))
    within = F.when(F.col("input_prompt").contains(BEFORE) & F.col("input_prompt").contains(AFTER) & (end >= start), F.substring("input_prompt", start + 1, end - start))
    contexts = F.array(F.struct(F.lit("input_prompt").alias("field"), zero.alias("item"), start.cast("bigint").alias("base"), within.alias("text")))
    return records.select("record_id", F.inline(F.concat(question, injected, contexts)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_record_texts(spark, d))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(_record_texts(spark, d), p4_found(spark, d))


def _injected(spark: SparkSession, d: str) -> DataFrame:
    """record_id and each text of injected_adv and injected_adv_defended."""
    both = F.array_distinct(F.concat(F.coalesce("injected_adv", F.array().cast("array<string>")), F.coalesce("injected_adv_defended", F.array().cast("array<string>"))))
    return table(spark, d, "records").select("record_id", F.explode(both).alias("text")).where("text is not null")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_records(_injected(spark, d), "record_id", "text")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.record_groups(_injected(spark, d), "record_id", "text")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and the longest document for each language as it is spelt."""
    docs = table(spark, d, "documents").select(F.struct("doc_id", "lang").alias("k"), "text")
    sizes = tokens.token_counts(docs, "k", "text")
    return sizes.groupBy(F.col("k.lang").alias("lang")).agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", table(spark, d, "containers"))


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_summary(p7_pack(spark, d))


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    """For each container what any packing needs, and the containers by the program and by first-fit decreasing alone."""
    sizes = tokens.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.plan_summary(sizes, "doc_id", "n_tokens", table(spark, d, "containers"))


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_stats(spark, d).where(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")


QUERIES = {f.__name__: f for f in (p2_found, p2_rates, p3_found, p3_types, p3_counts, p4_found, p4_shares, p5_found, p5_groups, p6_ids, p6_summary, p7_pack, p7_summary, p7_plan, p8_found, p8_stats)}
SQL: dict[str, str] = {
    "p4_found": r"""WITH c AS (SELECT record_id, input_prompt AS p, strpos(input_prompt, chr(10) || chr(10) || 'Contexts: ') - 1 + 12 AS s, length(input_prompt) - length(string_split(input_prompt, ' ' || chr(10) || chr(10) || 'Query: ')[-1]) - 10 AS e
  FROM records WHERE contains(input_prompt, chr(10) || chr(10) || 'Contexts: ') AND contains(input_prompt, ' ' || chr(10) || chr(10) || 'Query: ')),
t AS (SELECT record_id, 'question' AS field, 0 AS item, 0 AS base, question AS text FROM records
  UNION ALL SELECT record_id, 'injected_adv', unnest(range(0, len(injected_adv))), 0, unnest(injected_adv) FROM records
  UNION ALL SELECT record_id, 'input_prompt', 0, s, substr(p, s + 1, e - s) FROM c),
w AS (SELECT record_id, field, item, base, o, md5(substr(text, o + 1, 150)) AS h FROM (SELECT *, unnest(range(0, length(text) - 149)) AS o FROM t WHERE length(text) >= 150)),
d AS (SELECT h FROM w GROUP BY h HAVING min(record_id) <> max(record_id)),
s AS (SELECT record_id, field, item, base + o AS b, lag(base + o) OVER (PARTITION BY record_id, field, item ORDER BY o) AS p FROM w SEMI JOIN d USING (h)),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR b - p > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY record_id, field, item ORDER BY b) AS part FROM s)
SELECT record_id, field, CAST(item AS BIGINT) AS item, CAST(min(b) AS BIGINT) AS span_start, CAST(max(b) + 150 AS BIGINT) AS span_end FROM g GROUP BY record_id, field, item, part""",
    "p5_found": r"""WITH t AS (SELECT record_id, unnest(list_concat(coalesce(injected_adv, []), coalesce(injected_adv_defended, []))) AS x FROM records),
m AS (SELECT DISTINCT record_id, list_sort(list_distinct(regexp_extract_all(lower(x), '[a-z0-9'']+'))) AS w FROM t WHERE x IS NOT NULL),
s AS (SELECT w, len(w) AS n, row_number() OVER (ORDER BY w) AS id FROM (SELECT DISTINCT w FROM m WHERE len(w) > 0)),
p AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n WHERE len(list_intersect(a.w, b.w)) >= 0.8 * (a.n + b.n - len(list_intersect(a.w, b.w))) - 1e-9
  UNION ALL SELECT id, id FROM s),
r AS (SELECT record_id, id FROM m JOIN s USING (w))
SELECT DISTINCT least(x.record_id, y.record_id) AS record_a, greatest(x.record_id, y.record_id) AS record_b FROM p JOIN r x ON x.id = p.a JOIN r y ON y.id = p.b WHERE x.record_id <> y.record_id""",
}
