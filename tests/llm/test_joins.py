import random
import re

import numpy as np
import pytest

from ragtide.llm import neardup, prefixes, spans
from ragtide.llm.fmindex import FmIndex, shared_ranges


def words(t):
    return frozenset(re.findall("[a-z0-9']+", (t or "").lower()))


def brute_pairs(rows, least=0.8):
    got = set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            p, q = words(x), words(y)
            if a != b and p and q and len(p & q) >= least * len(p | q) - 1e-12:
                got.add((min(a, b), max(a, b)))
    return got


@pytest.mark.parametrize(("rare", "common"), [(64, 4096), (0, 4096), (0, 0), (2, 5)])
def test_similar_records_equal_brute_force(spark, monkeypatch, rare, common):
    monkeypatch.setattr(neardup, "RARE", rare)
    monkeypatch.setattr(neardup, "COMMON", common)
    rng = random.Random(rare + common)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 14))] for _ in range(12)]
    rows = []
    for i in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rng.shuffle(t)
        rows.append((i % 60, " ".join(t).upper() if i % 7 == 0 else ", ".join(t)))
    rows += [(100, None), (101, ""), (102, "…"), (0, rows[0][1]), (103, rows[0][1])]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "record_id bigint, text string, tokens string")
    got = {(r.record_a, r.record_b) for r in neardup.similar_records(df, "record_id", "text").collect()}
    assert got == brute_pairs(rows)
    assert neardup.similar_records(df.limit(0), "record_id", "text").count() == 0


def test_groups(spark):
    # a chain: 1 ~ 2 ~ 3, but 1 and 3 are not alike; 5 and 6 are copies
    t = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(t)), (2, " ".join(t[2:])), (3, " ".join(t[5:])), (4, "alone"), (5, "same words"), (6, "words, same"), (7, None)]
    df = spark.createDataFrame(rows, "record_id bigint, text string")
    got = {r.record_id: (r.group_id, r.n_links) for r in neardup.record_groups(df, "record_id", "text").collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (4, 0), 5: (5, 0), 6: (5, 0)}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u bigint, v bigint")
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_fm_index_equals_search():
    rng = random.Random(1)
    for _ in range(150):
        n, alphabet = rng.choice([3, 5, 8]), rng.choice(["ab", "abc", "abcdé漢"])
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 25))]
        owners = np.array([rng.randint(0, 4) for _ in texts])
        lo, hi = shared_ranges(texts, owners, np.arange(len(texts)), n)
        for i, t in enumerate(texts):
            at = [b for b in range(len(t) - n + 1) if any(owners[j] != owners[i] and t[b : b + n] in texts[j] for j in range(len(texts)))]
            assert (lo[i], hi[i]) == ((at[0], at[-1] + n) if at else (-1, -1))


def test_rank_counts():
    text = ["banana"]
    index = FmIndex(text, np.array([0]))
    code = {c: i + 1 for i, c in enumerate("abn")}
    assert index.matrix.rank(np.array([code["a"], code["n"]]), np.array([7, 7])).tolist() == [3, 2]


def brute_spans(rows, n):
    got = set()
    for rec, field, item, base, t in rows:
        t = t or ""
        mark = [False] * len(t)
        for b in range(len(t) - n + 1):
            if any(r != rec and t[b : b + n] in (x or "") for r, _, _, _, x in rows):
                mark[b : b + n] = [True] * n
        b = 0
        while b < len(t):
            e = b
            while e < len(t) and mark[e]:
                e += 1
            if e > b:
                got.add((rec, field, item, base + b, base + e))
            b = max(e, b + 1)
    return got


@pytest.mark.parametrize(("hot", "shard", "piece"), [(4000, 1_000_000, 30), (0, 1_000_000, 1 << 20), (2, 200, 1 << 20)])
def test_spans_equal_brute_force(spark, monkeypatch, hot, shard, piece):
    monkeypatch.setattr(spans, "PIECE", piece)
    rng = random.Random(hot + shard)
    passages = ["".join(rng.choice("abcdefé ") for _ in range(rng.randint(10, 60))) for _ in range(8)]
    rows = []
    for rec in range(25):
        for item in range(rng.randint(0, 3)):
            t = "".join(rng.choice([rng.choice(passages), "".join(rng.choice("ghij") for _ in range(rng.randint(1, 30)))]) for _ in range(rng.randint(1, 4)))
            rows.append((rec, "f", item, rng.choice([0, 7]), t))
    rows += [(30, "f", 0, 0, None), (31, "f", 0, 0, ""), (32, "f", 0, 0, "aaaa" * 30), (33, "g", 0, 0, "aaaa" * 25), (33, "g", 1, 0, "aaaa" * 25)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "record_id bigint, field string, item bigint, base bigint, text string, seed string")
    got = {tuple(r) for r in spans.shared_spans(df, 20, 8, hot, shard).collect()}
    assert got == brute_spans(rows, 20)


def test_spans_of_repeated_rows_nulls_and_nothing(spark):
    t = "x" * 5 + "abcdefghijklmnopqrstuvwxyz" * 2
    rows = [(1, "f", 0, 0, t), (1, "f", 0, 0, t), (None, "f", 0, 0, t)]
    df = spark.createDataFrame(rows, "record_id bigint, field string, item bigint, base bigint, text string")
    assert sorted(map(tuple, spans.shared_spans(df, 20, 8).collect()), key=str) == sorted([(1, "f", 0, 0, len(t)), (None, "f", 0, 0, len(t))], key=str)
    assert spans.shared_spans(df.limit(0), 20, 8).count() == 0
    share = {r.record_id: r.share for r in spans.shared_share(df.where("record_id = 1"), spans.shared_spans(df, 20, 8)).collect()}
    assert share[1] == 0.5  # its two rows are one value


def test_longer_copies(spark):
    rng = random.Random(2)
    values = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.rest for r in prefixes.longer_copies(df, "v").collect()}
    distinct = {v for v in values if v}
    want = {v for v in distinct if any(w != v and w.startswith(v) for w in distinct)}
    assert set(got) == want
    assert all(v + rest in distinct for v, rest in got.items())
    assert prefixes.longer_copies(df.limit(0), "v").count() == 0


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_longer_copies_among_flagged_values(spark, parts):
    rng = random.Random(int(parts))
    rows = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))): rng.random() < 0.3 for _ in range(150)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([*rows.items(), *list(rows.items())[:20], (None, True), ("", True)], "v string, said boolean")
        got = {r.v: r.rest for r in prefixes.longer_copies(df, "v", "said").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    copies = sorted(v for v, said in rows.items() if said)
    want = {v: next(c for c in copies if c > v and c.startswith(v))[len(v) :] for v in rows if any(c > v and c.startswith(v) for c in copies)}
    assert got == want


def test_ranges_with_groups_cover_those_without(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abc") for _ in range(60)) for _ in range(6)]
    texts = [(b := rng.choice(base))[rng.randrange(8) : len(b) - rng.randrange(8)] + "".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(60)]
    owners = np.array([rng.randrange(20) for _ in texts])
    which = np.array(rng.sample(range(60), 40))
    lo, hi = shared_ranges(texts, owners, which, 30)
    for w, a, b in zip(which, lo, hi, strict=True):
        foreign = [t for t, o in zip(texts, owners, strict=True) if o != owners[w]]
        shared = [i for i in range(len(texts[w]) - 29) if any(texts[w][i : i + 30] in t for t in foreign)]
        assert (a, b) == ((shared[0], shared[-1] + 30) if shared else (-1, -1))
    one = np.zeros(60, np.int64)
    assert [x.tolist() for x in shared_ranges(texts, owners, which, 30, one)] == [lo.tolist(), hi.tolist()]
    index = FmIndex(texts, owners)
    assert index.ends_shared(which, 30).tolist() == [len(texts[w]) == b for w, b in zip(which, hi, strict=True)]
