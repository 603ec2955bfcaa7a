import pytest

from ragtide.operators import metrics as M
from ragtide.operators import passages as S
from ragtide.operators import retrieval


def brute(text, question, answer, near=frozenset()):
    import re

    words = re.findall("[a-z0-9']+", (text or "").lower())
    keys = sorted(set(re.findall("[a-z0-9']+", ((question or "") + " " + (answer or "")).lower())))
    same = lambda w, k: w == k or frozenset((w, k)) in near
    hits = [w for w in words if any(same(w, k) for k in keys)]
    return (len(hits) / len(set(words)) if words else 0.0, len(hits), len(set(words)), sorted({k for k in keys if any(same(w, k) for w in words)}))


ROWS = [
    (1, 0, "The cat sat. The CAT ran!", "who is the cat", None), (1, 1, "", "who", "x"), (1, 2, None, None, None), (2, 0, "cats and dogs, cats", "cat dog", "and"),
    (2, 1, "plain words", "", ""), (3, 0, "x " * 5000 + "end", "end of x", "of"),
]


@pytest.mark.parametrize("mode", ["exact", "semantic"])
def test_scores_are_those_of_brute_force(spark, mode):
    rows = spark.createDataFrame(ROWS, "record_id bigint, rank int, text string, question string, slm_answer string")
    near = spark.createDataFrame([("cat", "cats", 0.7), ("dogs", "dog", 0.6), ("plain", "words", 0.1)], "word_a string, word_b string, sim double")
    got = S.score_passages(rows, ["record_id", "rank"], matching_mode=mode, similar=near).collect()
    pairs = {frozenset(("cat", "cats")), frozenset(("dog", "dogs"))} if mode == "semantic" else frozenset()
    assert len(got) == len(ROWS)
    for r in got:
        score, total, distinct, keys = brute(r.text, r.question, r.slm_answer, pairs)
        assert (round(r.freq_density_score, 9), r.matched_freq_sum, r.unique_word_count, r.matched_keyword_count, list(r.matched_keywords_sample)) == (round(score, 9), total, distinct, len(keys), keys[:20])
        assert (r.matching_mode, r.semantic_threshold) == (mode, 0.6 if mode == "semantic" else None)


def test_unknown_mode_and_missing_table(spark):
    rows = spark.createDataFrame(ROWS, "record_id bigint, rank int, text string, question string, slm_answer string")
    with pytest.raises(ValueError, match="no such matching mode"):
        S.score_passages(rows, ["record_id", "rank"], matching_mode="fuzzy")
    with pytest.raises(ValueError, match="table of similar words"):
        S.score_passages(rows, ["record_id", "rank"], matching_mode="semantic")


def test_texts_of_passages(spark):
    rows = spark.createDataFrame([(1, 0, "7"), (1, 1, "adv::q::1"), (1, 2, "adv::q::9"), (2, 0, "adv::q::0"), (2, 1, "8"), (2, 2, None), (2, 3, "none"), (1, 0, "7")], "record_id bigint, rank int, doc_id string")
    docs = spark.createDataFrame([(7, "seven", "x"), (8, None, "y")], "doc_id bigint, text string, rank string")
    records = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "record_id bigint, injected_adv array<string>")
    got = sorted((r.record_id, r["rank"], r.text) for r in S.passage_text(rows, docs, records).collect())
    assert got == [(1, 0, "seven"), (1, 0, "seven"), (1, 1, "b"), (1, 2, None), (2, 0, None), (2, 1, None), (2, 2, None), (2, 3, None)]
    assert S.passage_text(rows.limit(0), docs, records).count() == 0


def test_answers_in_passages(spark):
    rows = [(1, "a cafe\u0301 there", ["café"]), (2, "no such thing", ["such", "x"]), (3, "words apart", ["word"]), (4, None, ["a"]), (5, "text", None), (6, "text", [None, ""]), (7, "two words here", ["two\nwords"])]
    got = {r.i: r.has_answer for r in M.has_answer(spark.createDataFrame(rows, "i int, t string, a array<string>"), "t", "a").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: True}


def test_best_gold(spark):
    rows = [(1, "The cat", ["dog", "cat"]), (2, None, ["a"]), (3, "x", None), (4, "x y", [None, "y z"]), (5, "", [""])]
    got = {r.i: (r.em, r.f1) for r in M.exact_and_f1(spark.createDataFrame(rows, "i int, p string, g array<string>"), "i", "p", "g").collect()}
    assert got == {1: (1, 1.0), 2: (None, None), 3: (None, None), 4: (0, 0.5), 5: (1, 0.0)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 50])
def test_split_has_its_share(spark, n):
    df = spark.createDataFrame([(g, f"q{i % max(n, 1)}") for g in ("a", "b") for i in range(2 * n)] + [("a", None)], "g string, q string")
    got = M.group_split(df, "q", by=["g"]).collect()
    assert len(got) == 2 * n == len({(r.g, r.q) for r in got})
    for g in "ab":
        assert sum(r.split == "test" for r in got if r.g == g) == (max(1, round(n * 0.2)) if n else 0)


def test_area_under_curve_in_pieces(spark):
    import random

    rng = random.Random(4)
    rows = [(g, rng.random() < 0.4, rng.choice([rng.random(), 0.5, 0.25])) for g in ("a", None) for _ in range(300)] + [("one", True, 0.5)]
    got = {r.g: r.auc for r in M.roc_auc(spark.createDataFrame(rows, "g string, y boolean, s double"), ["g"], "y", "s").collect()}
    for g in ("a", None):
        own = [(y, s) for h, y, s in rows if h == g]
        wins = [(s > t) + (s == t) / 2 for y, s in own if y for x, t in own if not x]
        assert got[g] == pytest.approx(sum(wins) / len(wins))
    assert got["one"] is None


def test_blocks_of_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).round(2)
    x[5] = x[6] = x[7]
    x[8] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None] * 8)]
    c = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>").repartition(5)
    q = c.where("doc_id % 50 = 5 or doc_id > 899").withColumnRenamed("doc_id", "query_id")
    for metric in ("cosine", "dot"):
        unit = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
        s = unit @ unit.T if metric == "cosine" else x @ x.T
        for limit in (retrieval.BROADCAST_BYTES, 0):
            retrieval.BROADCAST_BYTES, before = limit, retrieval.BROADCAST_BYTES
            got = retrieval.top_k(q, c, 4, metric, skip_self=True).collect()
            retrieval.BROADCAST_BYTES = before
            want = {(i, j, r) for i in range(5, 300, 50) for r, j in enumerate(sorted((j for j in range(300) if j != i), key=lambda j: (-round(s[i, j], 9), j))[:4])}
            assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == want
    assert retrieval.top_k(q.limit(0), c, 4).count() == 0
    assert retrieval.top_k(q, c.limit(0), 4).count() == 0
