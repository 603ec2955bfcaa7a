import random

import numpy as np
import pytest

from ragtide.llm import quality
from ragtide.llm.textstats import Part, Tables, measure

TABLES = Tables(["the", "of", "and", "in", "was", "is", "a"])


def test_chunks_merge_to_the_whole_in_any_grouping():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("a b.c\n\n  |\t*1='\"é…   x)the ") for _ in range(rng.randint(1, 300)))
        whole = measure([t], TABLES)[0][0]
        cuts = sorted({0, len(t), *(rng.randrange(len(t)) for _ in range(rng.randint(1, 7)))})
        chunks = [t[max(0, a - 64) : b + 64] for a, b in zip(cuts, cuts[1:], strict=False)]
        _, parts = measure(chunks, TABLES, [min(64, a) for a in cuts[:-1]], [min(64, len(t) - b) for b in cuts[1:]])
        left, right = Part(), Part()
        for p in parts:
            left = left.join(p)
        for p in reversed(parts):
            right = p.join(right)
        assert np.array_equal(left.total(), whole)
        assert np.array_equal(right.total(), whole)


PROSE = "The treaty of the town was signed in the summer. It was kept in a chest and is now lost. The people of the valley still tell the story."
KINDS = [
    (PROSE, "prose"), ("\n".join(f"- {s}." for s in PROSE.split(". ")), "prose"), (PROSE.lower(), "prose"), ("\n".join(["Tulkvik", "Drimhaven", "Hilmholm", "Fesswick", "Brandal"]), "list"),
    ("* red map\n* old mill\n* wide opera\n* small yard\n* new press", "list"), ("Anna Berg, Karl Holm, Ida Lund, Nils Dahl, Eva Strand, Ole Vik", "list"), ("name\tyear\tk\nOslo\t1\t2\nRome\t3\t4\nBern\t5\t6", "table"),
    ("| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", "table"), ("a,b,c\n1,2,3\n4,5,6\n7,8,9", "table"), ("dam " * 40, "junk"), ("■□�▒■□�▒" * 20, "junk"), ("xkcbvzft zqanf tsch vwkk qbhp lfmk qeywf dxcn gtlg jdwd", "junk"),
    ("sFP5VQMXs5hXpSJVPUZDXf1aLlhC0qbDknIuyA/p5ZmUJe1zWZUoPwKB3Hax6mbrcyyBS7Q0P5C==", "junk"), ("", ""), (None, ""), (" \n\t ", ""),
]


@pytest.mark.parametrize("chunk", [40, 100000])
def test_kinds_whole_and_in_chunks(spark, chunk):
    words = spark.createDataFrame([(w, 1) for w in TABLES.common_words] + [(None, 2)], "word string, chars int")
    rows = [(i, t, "clash") for i, (t, _) in enumerate(KINDS)] + [(0, PROSE, "clash"), (None, PROSE, "clash")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, words string")
    got = quality.text_quality(df, "doc_id", "text", words, chunk).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.kind for r in got if r.doc_id is not None} == {i: k for i, (_, k) in enumerate(KINDS)}
    empty = next(r for r in got if r.doc_id == len(KINDS) - 3)
    assert (empty.words, empty.mean_word_length, empty.symbol_ratio) == (0, None, None)
    assert quality.text_quality(df.limit(0), "doc_id", "text", words).count() == 0


def test_chunked_sums_equal_whole_ones(spark, data):
    docs, words = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "common_words"))
    a = quality.text_sums(docs, "doc_id", "text", words, 100).toPandas().sort_values("doc_id").reset_index(drop=True)
    b = quality.text_sums(docs, "doc_id", "text", words, 10**9).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert a.equals(b)


def test_labelled_documents(spark, data):
    docs, words, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "common_words", "doc_labels"))
    got = quality.text_quality(docs, "doc_id", "text", words).select("doc_id", quality.F.col("kind").alias("found")).join(labels, "doc_id")
    assert got.where("found = kind").count() >= 0.9 * got.count()  # a few labels are wrong


def test_rule_outcomes(spark):
    words = spark.createDataFrame([(w,) for w in TABLES.common_words], "word string")
    rows = [(0, " ".join([PROSE] * 3)), (1, "dam " * 60), (2, "\n".join(f"* {w}" for w in "abcdefghij")), (3, None), (4, "WE 1234567 ## 999 !!")]
    got = {r.doc_id: r for r in quality.text_quality(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", words).collect()}
    assert got[0].rules_failed == 0 and got[0].kind == "prose"
    assert (got[1].rule_enough_words, got[1].rule_few_repeats, got[1].rule_common_words, got[1].rule_ended_lines, got[1].rule_sentence_ends) == (True, False, False, False, False)
    assert (got[2].rule_few_bullets, got[2].rule_enough_words) == (False, False)
    assert got[3].rule_word_length is None and got[3].rules_failed == 1  # only its number of words is known
    assert (got[4].rule_few_digits, got[4].rule_few_symbols) == (False, False)
