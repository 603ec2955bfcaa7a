import random
import time

import numpy as np
import pyarrow as pa
import pytest

from ragtide.llm import packing, tokens
from ragtide.llm.bytebpe import PerfectHash

ODD = ["", None, " ", "\n\n", "'s", "it's we'll I'M 'S ''s x'st", "<|endoftext|> <|endoftext|>", "a" * 3000, "■" * 300, " " * 700, "é漢字 Ünïcode 😀 ١٢٣ ²³", "tab\t\tx  y z　.", "don’t", "͸\U0001fae9"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    try:
        t = tokenizers.Tokenizer.from_file(tokens.BYTE_BPE_50K)
    except Exception:
        pytest.skip("no vocabulary file")
    t.encode_special_tokens = True
    return t


def test_encoder_equals_the_library(library):
    rng = random.Random(5)
    alphabet = "ab'sStTdlmrve  \n\t 1٣²é漢■’<|endoftext|>.,"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    ids, counts = tokens.encoder(tokens.BYTE_BPE_50K).encode(pa.array(texts))
    ends = np.cumsum(counts)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == want


def test_long_texts_go_in_pieces(library, monkeypatch):
    from ragtide.llm import bytebpe

    rng = random.Random(6)
    text = "".join(rng.choice("ab é's \n1.漢") for _ in range(5000))
    want = library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bytebpe, "SLICE_BYTES", 100)
    assert len(list(bytebpe._pieces(text.encode()))) > 3
    ids, counts = tokens.encoder(tokens.BYTE_BPE_50K).encode(pa.array(["x", text, None, "y"]))
    assert ids[1:-1].tolist() == want
    assert counts.tolist() == [1, len(want), 0, 1]


def test_round_trip_and_clashing_names(spark, library):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "x", 1), (0, "", 1)], "doc_id bigint, text string, ids int")
    got = tokens.encode_column(df, "doc_id", "text").collect()
    assert len(got) == len(ODD) + 2
    assert all(library.decode(r.ids, skip_special_tokens=False) == (ODD[r.doc_id] or "") for r in got if r.doc_id is not None)
    assert tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df, "doc_id", "text").collect()}[1] == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).choice(10**9, n, replace=False).astype(np.uint64)
    h = PerfectHash(keys)
    assert h.find(keys).tolist() == list(range(n))
    assert (h.find(keys + np.uint64(10**10)) == -1).all()


def test_plan_holds_every_item():
    rng = np.random.default_rng(0)
    for _ in range(30):
        capacity = int(rng.integers(1, 80))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(0, 300)))
        lengths, counts = np.unique(sizes, return_counts=True)
        got, figures = packing.plan(lengths, counts, capacity, 40)
        held = np.zeros(capacity + 1, int)
        for pattern, times in got:
            assert sum(n * a for n, a in pattern) <= capacity
            for n, a in pattern:
                held[n] += a * times
        assert held[1:].tolist() == np.bincount(sizes, minlength=capacity + 1)[1:].tolist()
        used = sum(times for _, times in got)
        assert figures["lp_bound"] <= used == min(figures["program_bins"], figures["ffd_bins"])
        assert used <= 1.25 * -(-sizes.sum() // capacity) + 2


def brute_worth(sizes, prices, room, live):
    worth = [0.0] * (room + 1)
    for c in range(1, room + 1):
        worth[c] = max([worth[c - 1]] + [worth[c - n] + p for n, p, on in zip(sizes, prices, live, strict=True) if on and n <= c])
    return worth[room]


def test_pattern_is_optimal_also_after_drops():
    rng = np.random.default_rng(3)
    for _ in range(60):
        room = int(rng.integers(1, 60))
        sizes = rng.permutation(np.arange(1, room + 5))[: int(rng.integers(1, 9))]
        prices = rng.random(len(sizes)) * sizes
        sack = packing.Knapsack(sizes, prices, room)
        for j in [None, *rng.permutation(len(sizes))]:
            if j is not None:
                sack.drop(int(j))
            copies, worth = sack.best()
            assert sum(int(sizes[i]) * a for i, a in copies.items()) <= room
            assert all(sack.live[i] for i in copies)
            assert sum(prices[i] * a for i, a in copies.items()) == pytest.approx(worth) == pytest.approx(brute_worth(sizes, prices, room, sack.live))


def test_program_needs_no_more_than_first_fit():
    rng = np.random.default_rng(8)
    sizes = np.minimum(rng.geometric(1 / 90, 20000) + 8, 512)
    lengths, counts = np.unique(sizes[sizes < 512], return_counts=True)
    got, figures = packing.plan(lengths, counts, 512)
    assert figures["program_bins"] <= figures["ffd_bins"] and figures["by_program"] == figures["program_bins"]
    assert sum(times for _, times in got) <= figures["lp_bound"] * 1.002 + 1


def test_halves_and_large_capacities():
    assert packing.plan(np.array([6]), np.array([7]), 10)[1] == {"lp_bound": 7, "program_bins": 7, "ffd_bins": 7, "by_program": 7}
    assert packing.plan(np.array([], np.int64), np.array([], np.int64), 10)[0] == []
    rng = np.random.default_rng(9)
    lengths, counts = np.unique(rng.integers(1, 30000, 5000), return_counts=True)
    began = time.time()
    got, figures = packing.plan(lengths, counts, 131072)
    assert time.time() - began < 60
    assert sum(counts) == sum(a * times for pattern, times in got for _, a in pattern)
    assert all(sum(n * a for n, a in pattern) <= 131072 for pattern, _ in got)
    assert figures["program_bins"] <= figures["lp_bound"] * 1.02 + 1


def test_pack(spark):
    rows = [(i, n) for i, n in enumerate([0, None, 5, 5, 10, 23, 3, 3, 3, 1])] + [(2, 5), (None, 4)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n bigint")
    containers = spark.createDataFrame([("c10", 10), ("c4", 4), ("bad", None), ("zero", 0)], "container string, capacity bigint")
    got = packing.pack(sizes, "doc_id", "n", containers, 20).toPandas()
    for name, cap in (("c10", 10), ("c4", 4)):
        own = got[got.container == name]
        assert own.groupby("bin_id").part_size.sum().max() <= cap
        assert own.part_size.sum() == sum(n or 0 for _, n in rows)
        assert (own.groupby("doc_id", dropna=False).part_size.sum().sort_index().tolist()) == [0, 0, 10, 5, 10, 23, 3, 3, 3, 1, 4]
        solid = own[own.part_size > 0].sort_values(["bin_id", "bin_start"])
        following = solid.groupby("bin_id").bin_start.shift(-1)
        assert not (solid.bin_start + solid.part_size > following).any()
        whole = own[own.part > 0].doc_id.dropna().unique()
        assert set(whole) <= {r[0] for r in rows if (r[1] or 0) > cap}  # only what exceeds the capacity is split
    assert packing.pack(sizes.limit(0), "doc_id", "n", containers, 20).count() == 0
    assert packing.pack(sizes, "doc_id", "n", containers.limit(0), 20).count() == 0
    figures = {r.container: r for r in packing.plan_summary(sizes, "doc_id", "n", containers, 20).collect()}
    assert set(figures) == {"c10", "c4"} and packing.plan_summary(sizes, "doc_id", "n", containers.limit(0)).count() == 0
    assert all(f.bins == got[got.container == name].bin_id.max() + 1 and f.lp_bound <= f.bins for name, f in figures.items())
    summary = {r.container: r for r in packing.pack_summary(packing.pack(sizes, "doc_id", "n", containers, 20)).collect()}
    assert summary["c10"].bins >= summary["c10"].least_bins


def test_pack_drops_no_container(spark):
    sizes = spark.createDataFrame([(1, 3)], "doc_id bigint, n bigint")
    containers = spark.range(1001).selectExpr("cast(id as string) as container", "id + 5 as capacity")
    with pytest.raises(ValueError, match="more than 1000 containers"):
        packing.pack(sizes, "doc_id", "n", containers)
