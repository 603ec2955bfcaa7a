"""The texts of retrieved passages, and their lexical scores against a question and a small model's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtide.functions.text import frequency_density, token_hits, tokens

#: How a passage word is held to match a keyword, the least similarity of the second way, and how many matched keywords are shown.
MATCHING_MODES = ("exact", "semantic")
SEMANTIC_THRESHOLD = 0.6
SAMPLE = 20


def passage_text(rows: DataFrame, documents: DataFrame, records: DataFrame, into: str = "text") -> DataFrame:
    """``rows`` (record_id, doc_id) with the whole text of each passage in ``into``.

    A doc_id adv::<query>::<n> is the text n of injected_adv of the row's record in ``records``; another one is the number of a row
    of ``documents`` (doc_id, text). Null where the passage is not found or has no text; no row is lost or repeated as long as
    doc_id and record_id are unique there. Both joins are on plain keys, so AQE splits a document or record that is asked for by many rows;
    each row goes through one of them only, so no text is shuffled after it is found.
    """
    injected = F.coalesce(F.col("doc_id").startswith("adv::"), F.lit(False))
    place = F.element_at(F.split("doc_id", "::"), -1).try_cast("int")
    docs = documents.select(F.col("doc_id").alias("_number"), F.col("text").alias("_plain"))
    given = records.select(F.col("record_id").alias("_of"), F.col("injected_adv").alias("_injected")).where("_injected is not null")
    plain = rows.where(~injected).withColumn("_number", F.col("doc_id").try_cast("bigint")).join(docs, "_number", "left").select(*rows.columns, F.col("_plain").alias(into))
    own = rows.where(injected).withColumn("_of", F.col("record_id")).join(given, "_of", "left").select(*rows.columns, F.get("_injected", place).alias(into))
    return plain.unionByName(own)


def _mode(matching_mode: str) -> None:
    if matching_mode not in MATCHING_MODES:
        raise ValueError(f"no such matching mode: {matching_mode}; there are {', '.join(MATCHING_MODES)}")


def keywords(question: Column, answer: Column | None = None) -> Column:
    """Distinct tokens of the question and, if there is one, of a small model's answer, which may be null; in order."""
    given = tokens(question) if answer is None else F.concat(tokens(question), tokens(answer))
    return F.array_sort(F.array_distinct(given))


def score_passages(rows: DataFrame, keys: list[str], question: str = "question", answer: str | None = "slm_answer", text: str = "text", matching_mode: str = "exact", similar: DataFrame | None = None, threshold: float = SEMANTIC_THRESHOLD) -> DataFrame:
    """``rows`` with matching_mode, semantic_threshold, freq_density_score, matched_freq_sum, unique_word_count, matched_keyword_count and matched_keywords_sample.

    The score is the number of occurrences of matched words over the distinct words of the passage, so it can exceed 1; 0 for a
    passage or a question without words. exact: a word matches a keyword that equals it, in place, without a shuffle. semantic: also a keyword that ``similar``
    (word_a, word_b, sim; either order) holds at ``threshold`` at least; distinct words of a passage are joined with that table by
    word. ``keys`` tell the rows apart. Without ``answer`` the keywords are the question's alone.
    """
    _mode(matching_mode)
    named = rows.withColumn("_keys", keywords(F.col(question), F.col(answer) if answer else None)).withColumn("_words", tokens(F.col(text)))
    distinct = F.size(F.array_distinct("_words"))
    if matching_mode == "exact":
        hits = token_hits(F.col(text), F.col("_keys"))
        got = named.withColumn("_matched", F.array_intersect("_keys", "_words")).withColumn("matched_freq_sum", hits).withColumn("unique_word_count", distinct)
    else:
        if similar is None:
            raise ValueError("semantic matching needs a table of similar words")
        near = similar.where(F.col("sim") >= threshold).select("word_a", "word_b")
        near = near.unionByName(near.select(F.col("word_b").alias("word_a"), F.col("word_a").alias("word_b"))).groupBy(F.col("word_a").alias("_w")).agg(F.collect_set("word_b").alias("_near"))
        each = named.select(*keys, "_keys", F.explode("_words").alias("_w")).groupBy(*keys, "_keys", "_w").agg(F.count("*").alias("_m"))
        held = each.join(near, "_w", "left").withColumn("_hit", F.array_intersect("_keys", F.array_append(F.coalesce("_near", F.array().cast("array<string>")), F.col("_w"))))
        summed = held.groupBy(*keys).agg(
            F.coalesce(F.sum(F.when(F.size("_hit") > 0, F.col("_m"))), F.lit(0)).cast("int").alias("matched_freq_sum"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hit")))).alias("_matched")
        )
        got = named.join(summed, keys, "left").withColumns({"matched_freq_sum": F.coalesce("matched_freq_sum", F.lit(0)), "_matched": F.coalesce("_matched", F.array().cast("array<string>")), "unique_word_count": distinct})
    return got.select(
        *rows.columns, F.lit(matching_mode).alias("matching_mode"), F.lit(threshold if matching_mode == "semantic" else None).cast("double").alias("semantic_threshold"),
        F.coalesce(F.try_divide("matched_freq_sum", "unique_word_count"), F.lit(0.0)).alias("freq_density_score"), "matched_freq_sum", "unique_word_count",
        F.size("_matched").alias("matched_keyword_count"), F.slice("_matched", 1, SAMPLE).alias("matched_keywords_sample"),
    )


def answer_only_score(text: Column, answer: Column) -> Column:
    """The density of the answer's own tokens; 0 without an answer."""
    return frequency_density(text, F.array_distinct(tokens(answer)))


def score_rows(rows: DataFrame, keys: list[str], preview: int = 200) -> DataFrame:
    """``rows`` (keys, question, slm_answer, text, and what a score row keeps of a passage) with filterrag_score, query_only_score, answer_token_overlap_score and text_preview, from the whole texts."""
    lasting = [c for c in rows.columns if c not in ("filterrag_score", "query_only_score", "answer_token_overlap_score", "text_preview")]
    full = score_passages(rows.select(*lasting), keys).withColumn("filterrag_score", F.col("freq_density_score")).select(*lasting, "filterrag_score")
    both = score_passages(full, keys, answer=None).withColumn("query_only_score", F.col("freq_density_score")).select(*full.columns, "query_only_score")
    shown = F.translate(F.substring("text", 1, preview), "\n", " ")
    return both.withColumn("answer_token_overlap_score", answer_only_score(F.col("text"), F.col("slm_answer"))).withColumn("text_preview", shown)
