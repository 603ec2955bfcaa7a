"""Columns that a model gives, with offline stand-ins that name themselves in ``notes``. Each is DataFrame -> DataFrame and adds one nullable column."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ragtide.functions.text import tokens
from ragtide.sources.tables import durable

#: Words of a unigram model, and characters of them, up to which they are sent to all tasks.
WORDS, WORD_CHARS = 500_000, 8_000_000
Unigram = tuple[DataFrame, Broadcast, int, int]


def answers_from(df: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """slm_answer from a table of answers; null where it has none."""
    return df.join(answers.select(*on, "slm_answer"), on, "left")


def no_answers(df: DataFrame) -> DataFrame:
    """slm_answer null: the query-only form."""
    return df.withColumn("slm_answer", F.lit(None).cast("string"))


def unigram(corpus: DataFrame, text: str) -> Unigram:
    """The add-one unigram model of ``corpus``: how often each word occurs (w, n), minus the log-probabilities of the most frequent words as sent to all tasks, all occurrences and kinds and 1, and the least n of the words sent.

    Those are as many of the most frequent words as WORDS and WORD_CHARS allow; the words of one n are sent together or not at all.
    """
    counts = durable(corpus.select(F.explode(tokens(F.col(text))).alias("w")).groupBy("w").agg(F.count("*").alias("n")))
    by = counts.groupBy("n").agg(F.count("*").alias("kinds"), F.sum(F.length("w")).alias("chars")).collect()  # a row a frequency
    least, kinds, chars = 1 + max((r.n for r in by), default=0), 0, 0
    for r in sorted(by, reverse=True):
        kinds, chars = kinds + r.kinds, chars + r.chars
        if kinds > WORDS or chars > WORD_CHARS:
            break
        least = r.n
    else:
        least = 1
    total = sum((r.n + 1) * r.kinds for r in by) + 1
    few = counts.where(F.col("n") >= least).toArrow()  # WORDS rows at most
    sent = corpus.sparkSession.sparkContext.broadcast(dict(zip(few["w"].to_pylist(), (-np.log((few["n"].to_numpy() + 1) / total)).tolist(), strict=True)))
    return counts, sent, total, least


def _costs(batches: Iterator[pa.RecordBatch], sent: Broadcast, total: int, unseen: int | None) -> Iterator[pa.RecordBatch]:
    """For each text _digest, _rows 1, _all (its tokens) and _sum (minus the sum of their log-probabilities). Words that were not sent occur ``unseen`` times; if that is None they have a row each, with _word, and are not in the text's own."""
    words = re.compile("[a-z0-9']+").findall
    cost = sent.value
    other = None if unseen is None else -math.log((unseen + 1) / total)
    for batch in batches:
        rows = []
        for digest, text in zip(batch["_digest"].to_pylist(), batch["_text"].to_pylist(), strict=True):
            read = words(text)
            if not read:
                continue
            got = [cost.get(w, other) for w in read]
            if None in got:
                rows += [(digest, w, 0, n, 0.0) for w, n in Counter(w for w, c in zip(read, got, strict=True) if c is None).items()]
                got = [c for c in got if c is not None]
            rows.append((digest, None, 1, len(got), math.fsum(got)))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["_digest", "_word", "_rows", "_all", "_sum"])


def _nll(df: DataFrame, text: str, model: Unigram, within: bool = False) -> DataFrame:
    """_digest, _len, _nll of the distinct texts with tokens: their number and minus the sum of their log-probabilities by ``model``.

    Texts are told apart by their SHA-256, so no text is shuffled; what rows of one text sum up to is divided by their number.
    Frequent words are sent to all tasks, so a text's words are summed where it is read. Only other words are shuffled; where the texts are
    ``within`` the corpus and only words that occur once are left, they need no join either.
    """
    counts, sent, total, least = model
    unseen = least - 1 if least == 1 or (within and least == 2) else None
    read = df.where(F.col(text).isNotNull()).select(F.unhex(F.sha2(text, 256)).alias("_digest"), F.lower(text).alias("_text"))
    parts = read.mapInArrow(lambda b: _costs(b, sent, total, unseen), "_digest binary, _word string, _rows bigint, _all bigint, _sum double")
    if unseen is None:
        cost = F.when(F.col("_word").isNull(), F.col("_sum")).otherwise(F.col("_all") * -F.log((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total))))
        keyed = parts.withColumn("w", F.coalesce("_word", F.concat(F.lit(" "), F.hex("_digest"))))  # no token has a blank: what is summed already meets no word, and no task gets all of it
        parts = keyed.join(counts.where(F.col("n") < least), "w", "left").withColumn("_sum", cost)
    summed = parts.groupBy("_digest").agg(*[F.sum(c).alias(c) for c in ("_rows", "_all", "_sum")])
    return summed.select("_digest", (F.col("_all") / F.col("_rows")).cast("bigint").alias("_len"), (F.col("_sum") / F.col("_rows")).alias("_nll"))


def _unigram(df: DataFrame, text: str, model: Unigram) -> DataFrame:
    """``df`` with _len and _nll of ``text``."""
    return df.withColumn("_digest", F.unhex(F.sha2(text, 256))).join(_nll(df, text, model), "_digest", "left").drop("_digest")


def _perplexity() -> Column:
    return F.when(F.coalesce("_len", F.lit(0)) < 2, F.lit(1.0)).otherwise(F.exp(F.col("_nll") / F.col("_len"))).alias("perplexity")


def corpus_perplexity(corpus: DataFrame, text: str, model: Unigram) -> DataFrame:
    """_digest (the SHA-256) and perplexity of the corpus's own texts that have tokens."""
    return _nll(corpus, text, model, within=True).select("_digest", _perplexity())


def noted(df: DataFrame, note: str) -> DataFrame:
    """``note`` in notes, behind what is there."""
    return df.withColumn("notes", F.concat_ws("; ", *(["notes"] if "notes" in df.columns else []), F.lit(note)))


def unigram_perplexity(df: DataFrame, text: str, corpus: DataFrame, corpus_text: str, model: Unigram | None = None) -> DataFrame:
    """perplexity by an add-one unigram model of ``corpus`` (``model``, if it is made already), a stand-in for a language model's; 1 for texts of fewer than two tokens."""
    got = _unigram(df, text, model or unigram(corpus, corpus_text))
    got = got.withColumn("perplexity", _perplexity()).drop("_len", "_nll")
    return noted(got, "perplexity: unigram proxy")


def unigram_logprob(df: DataFrame, answer: str, corpus: DataFrame, corpus_text: str, model: Unigram | None = None) -> DataFrame:
    """slm_answer_logprob, the joint log-probability of an answer's tokens by the same model, a stand-in for the answering model's own; 0 without an answer."""
    got = _unigram(df, answer, model or unigram(corpus, corpus_text)).withColumn("slm_answer_logprob", F.coalesce(-F.col("_nll"), F.lit(0.0))).drop("_len", "_nll")
    return noted(got, "slm_answer_logprob: unigram proxy")


def plural_similarity(words: DataFrame) -> DataFrame:
    """(word_a, word_b, sim): a word and its plural in s, 0.9 alike; a stand-in for the word similarities of an encoder. ``words`` has a column word."""
    known = words.where(F.length("word") > 2).select("word").distinct()
    plural = known.where(F.col("word").endswith("s")).select(F.col("word").alias("word_b"), F.expr("left(word, length(word) - 1)").alias("word_a"))
    return plural.join(known.select(F.col("word").alias("word_a")), "word_a", "left_semi").select("word_a", "word_b", F.lit(0.9).alias("sim"))


@F.pandas_udf(ArrayType(DoubleType()))
def _unit_counts(hashed: pd.Series, size: pd.Series) -> pd.Series:
    def one(h: np.ndarray, n: int) -> np.ndarray:
        counts = np.bincount(h, minlength=n).astype(float)
        return counts / (np.linalg.norm(counts) or 1)

    return pd.Series([one(np.asarray(h, np.int64), int(n)) for h, n in zip(hashed, size, strict=True)], dtype=object)


def embedding_hashed(df: DataFrame, text: str, size: int = 64) -> DataFrame:
    """embedding: hashed token counts at unit length (all 0 without tokens), a stand-in for an encoder."""
    hashed = F.transform(tokens(F.col(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    return noted(df.withColumn("embedding", _unit_counts(hashed, F.lit(size))), "embedding: hashed proxy")


#: Providers by the name of a configuration's setting; another one is added with ``register``.
PROVIDERS: dict[str, dict[str, Callable[..., DataFrame]]] = {
    "answer": {"table": answers_from, "none": no_answers}, "perplexity": {"unigram": unigram_perplexity}, "logprob": {"unigram": unigram_logprob}, "embedding": {"hashed": embedding_hashed}, "similarity": {"plural": plural_similarity},
}


def register(kind: str, name: str, provider: Callable[..., DataFrame]) -> None:
    """Makes a provider known; it is DataFrame -> DataFrame and adds its one column."""
    PROVIDERS.setdefault(kind, {})[name] = provider


def create(config: dict[str, object]) -> Callable[..., DataFrame]:
    """The provider that a configuration names by kind and name, with its params filled in; an unknown one raises."""
    kind, name = str(config.get("kind")), str(config.get("name"))
    if name not in PROVIDERS.get(kind, {}):
        raise ValueError(f"no {kind} provider {name}; there are {', '.join(f'{k}/{n}' for k, names in PROVIDERS.items() for n in names)}")
    return partial(PROVIDERS[kind][name], **dict(config.get("params") or {}))
