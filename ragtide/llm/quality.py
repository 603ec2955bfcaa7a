"""Quality statistics of whole texts, and the kind of text that they show."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtide.llm.textstats import ALL, CONTEXT, Line, Part, Tables, measure
from ragtide.sources.tables import spread

#: Texts of more characters than this are cut into chunks of as many.
CHUNK = 8192
#: Chunks merged in one task before the last merge of a text.
FAN_IN = 256
MOST_COMMON_WORDS = 100_000


#: A partial state: the sums of closed lines, the open line at either end (sums, first and last characters), and whether both are one.
STATE = "_sums array<bigint>, _head_sums array<bigint>, _head string, _head_last string, _tail_sums array<bigint>, _tail string, _tail_last string, _single boolean"
STATE_NAMES = [part.split(" ")[0] for part in STATE.split(", ")]


def _to_row(p: Part) -> tuple:
    ends = [(None, None, None) if line is None else (line.sums, line.head, line.last) for line in (p.head, p.tail)]
    return (p.sums, *ends[0], *ends[1], p.single)


def _from_row(row: tuple) -> Part:
    sums, head_sums, head, head_last, tail_sums, tail, tail_last, single = row
    if head_sums is None:
        return Part()
    return Part(np.asarray(sums, np.int64), Line(np.asarray(head_sums, np.int64), head, head_last), Line(np.asarray(tail_sums, np.int64), tail, tail_last), bool(single))


def _tables(common_words: DataFrame) -> Tables:
    words = [r[0] for r in common_words.select("word").where("word is not null").distinct().limit(MOST_COMMON_WORDS + 1).collect()]
    if len(words) > MOST_COMMON_WORDS:
        raise ValueError(f"common_words holds more than {MOST_COMMON_WORDS} words")
    return Tables(words)


def text_sums(df: DataFrame, key: str, text: str, common_words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``key`` and the counts ALL of each row's whole text; zeros for null and empty texts.

    Texts of up to ``chunk`` characters are counted in one narrow pass. Longer ones are cut into chunks that are
    dealt over the cluster, counted apart, and merged by a tree (FAN_IN chunks to a task, then the text), so no
    text is ever whole in one Python worker. Both ways give the same counts. Repeated rows and null keys stay rows of their own.
    """
    shared = df.sparkSession.sparkContext.broadcast(_tables(common_words))
    kind = df.schema[key].dataType.simpleString()
    sums = ", ".join(f"{name} bigint" for name in ALL)
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got, _ = measure(f["_text"].tolist(), shared.value)
            yield pd.concat([f[["_key"]], pd.DataFrame(got, columns=ALL, index=f.index)], axis=1)

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            _, parts = measure(f["_piece"].tolist(), shared.value, f["_before"].tolist(), f["_after"].tolist())
            yield _states(f[["_row", "_key", "_chunk"]], [p or Part() for p in parts])

    def _states(f: pd.DataFrame, parts: list[Part]) -> pd.DataFrame:
        made = zip(*map(_to_row, parts), strict=True) if parts else [[]] * len(STATE_NAMES)
        return pd.concat([f, pd.DataFrame({name: pd.Series(list(column), index=f.index, dtype=object) for name, column in zip(STATE_NAMES, made, strict=True)})], axis=1)

    def merged(f: pd.DataFrame) -> Part:
        got = Part()
        for row in f.sort_values("_chunk")[STATE_NAMES].itertuples(index=False, name=None):
            got = got.join(_from_row(row))
        return got

    def some(f: pd.DataFrame) -> pd.DataFrame:
        return _states(f.iloc[:1][["_row", "_key", "_chunk"]].assign(_chunk=f["_chunk"].min()), [merged(f)])

    def last(f: pd.DataFrame) -> pd.DataFrame:
        total = pd.DataFrame([merged(f).total()], columns=ALL)
        total.insert(0, "_key", f["_key"].iloc[:1].to_numpy())
        return total

    short = spread(rows.where((F.length("_text") <= chunk) | F.col("_text").isNull())).mapInPandas(whole, f"_key {kind}, {sums}")
    at = F.col("_chunk") * chunk
    cut = (
        rows.where(F.length("_text") > chunk)
        .withColumn("_row", F.monotonically_increasing_id())
        .select("*", F.explode(F.sequence(F.lit(0), F.floor((F.length("_text") - 1) / chunk).cast("int"))).alias("_chunk"))
        .select(
            "_row", "_key", "_chunk", F.least(at, F.lit(CONTEXT)).alias("_before"), F.greatest(F.lit(0), F.least(F.length("_text") - at - chunk, F.lit(CONTEXT))).alias("_after"),
            F.substring("_text", F.greatest(at - CONTEXT, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT)) + chunk + CONTEXT).alias("_piece"),
        )
    )
    state = f"_row bigint, _key {kind}, _chunk int, {STATE}"
    parts = cut.repartition(F.col("_row"), F.col("_chunk")).mapInPandas(part, state)
    tree = parts.groupBy("_row", F.floor(F.col("_chunk") / FAN_IN)).applyInPandas(some, state)
    return short.unionAll(tree.groupBy("_row").applyInPandas(last, f"_key {kind}, {sums}")).withColumnRenamed("_key", key)


def _share(a: str | Column, b: str) -> Column:
    return F.try_divide((F.col(a) if isinstance(a, str) else a).cast("double"), F.col(b))


def derive(sums: DataFrame, key: str) -> DataFrame:
    """The statistics of each text from its counts; ratios are null where there is nothing to divide by."""
    c = F.col
    kept = sums.select(
        key, "chars", "words", "lines", _share("word_chars", "words").alias("mean_word_length"), _share("symbols", "visible").alias("symbol_ratio"), _share("digits", "visible").alias("digit_ratio"),
        _share("ended", "lines").alias("ended_lines"), _share("common", "words").alias("common_words"), _share("bullets", "lines").alias("bullet_lines"), _share("rows", "lines").alias("row_lines"),
        _share("leading", "lines").alias("leader_lines"), _share("repeats", "words").alias("repeated_words"), _share("stops", "words").alias("sentence_ends"), _share("broken", "visible").alias("broken_ratio"),
        _share("visible", "tokens").alias("mean_run_length"), _share("vowels", "letters").alias("vowel_ratio"), _share(c("humps") + c("mixed"), "words").alias("scrambled_words"), _share("rough", "visible").alias("rough_ratio"),
        _share(c("letters") + c("digits"), "visible").alias("alphanumeric_ratio"), _share("capitals", "words").alias("capital_words"), "letters", "commas", "semicolons", "visible", "commas2", "semicolons2", "tokens",
    )
    return kept


def kind_of() -> Column:
    """The kind of a text by ordered rules over its statistics: '' (nothing visible), junk, table, list or prose."""
    c, n = F.col, lambda name: F.coalesce(F.col(name), F.lit(0.0))

    def cells(name: str) -> Column:
        """Lines with the same number of separators: at least one each, and hardly any variance."""
        return (c(name) >= c("lines")) & (c("lines") >= 3) & (c(f"{name}2") * c("lines") - c(name) * c(name) <= 0.1 * c(name) * c(name))

    strange = n("common_words") < 0.2
    table = strange & ((c("lines") >= 2) & (n("row_lines") >= 0.5) & (n("leader_lines") < 0.5) | (cells("commas") | cells("semicolons")) & (n("bullet_lines") < 0.5))
    single = (c("lines") >= 3) & (c("tokens") < 1.5 * c("lines"))
    listed = (n("bullet_lines") >= 0.5) | (n("leader_lines") >= 0.5) | (c("lines") >= 3)
    for name in ("commas", "semicolons"):
        listed = listed | (c(name) >= 3) & (c(name) >= 0.2 * c("words"))
    noise = (n("broken_ratio") > 0.2) | (n("repeated_words") >= 0.5) & (c("words") >= 5) | (n("alphanumeric_ratio") < 0.3) & ~table & (n("leader_lines") < 0.5)
    blob = (n("mean_run_length") >= 25) & ~table
    rough = (n("rough_ratio") >= 0.1) & (n("bullet_lines") < 0.5)
    scrambled = strange & ~table & ((n("scrambled_words") >= 0.3) & ~single | rough | (n("vowel_ratio") < 0.27) & (c("letters") >= 20) & ~single)
    # badly read print keeps some common words, but marks and broken words run through it
    garbled = (n("symbol_ratio") >= 0.12) & (n("scrambled_words") >= 0.06) & ~table & ((c("lines") < 3) | ~strange)
    return (
        F.when(c("visible") == 0, "").when(noise | blob | scrambled | garbled, "junk").when(table, "table").when(strange & listed, "list").when(strange, "junk").otherwise("prose")
    )


#: Bounds of natural prose, a rule each: a statistic, and the least and the most that it may be (None: no bound).
RULES: dict[str, tuple[str, float | None, float | None]] = {
    "enough_words": ("words", 50, 100_000), "word_length": ("mean_word_length", 3, 10), "few_symbols": ("symbol_ratio", None, 0.1), "few_digits": ("digit_ratio", None, 0.2), "ended_lines": ("ended_lines", 0.5, None),
    "sentence_ends": ("sentence_ends", 0.01, 0.25), "common_words": ("common_words", 0.1, None), "few_bullets": ("bullet_lines", None, 0.9), "few_repeats": ("repeated_words", None, 0.3), "few_capitals": ("capital_words", None, 0.5),
}


def rule_outcomes() -> dict[str, Column]:
    """rule_<name> for each of RULES: whether the statistic lies within its bounds; null where there is no such statistic."""

    def within(name: str, least: float | None, most: float | None) -> Column:
        bounds = [F.col(name) >= least] * (least is not None) + [F.col(name) <= most] * (most is not None)
        return bounds[0] & bounds[-1]

    return {f"rule_{rule}": within(*bound) for rule, bound in RULES.items()}


def text_quality(df: DataFrame, key: str, text: str, common_words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Statistics and ``kind`` of every row's whole text.

    Returns ``key``, counts (chars, words, lines), ratios, the outcome of each of RULES, rules_failed (how many are false) and kind: prose, list, table, junk, or '' where
    nothing is visible (null, empty and blank texts). ``common_words`` has a column word; at most MOST_COMMON_WORDS words.
    """
    inner = ["letters", "commas", "semicolons", "visible", "commas2", "semicolons2", "tokens"]
    outcomes = rule_outcomes()
    failed = sum((F.when(F.col(name), 0).otherwise(F.when(F.col(name).isNull(), 0).otherwise(1)) for name in outcomes), F.lit(0))
    told = derive(text_sums(df, key, text, common_words, chunk), key).withColumn("kind", kind_of()).drop(*inner).withColumns(outcomes)
    return told.withColumn("rules_failed", failed)
