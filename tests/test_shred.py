import json
import random

from ragtide.operators import shred

SCHEMA = "file_id bigint, node string, body string"


def tables(spark, bodies):
    rows = [(i, "clash", b) for i, b in enumerate(bodies)]
    return shred.result_tables(spark.createDataFrame(rows, SCHEMA), "file_id", "body", ["question"])


def texts(spark, bodies):
    got = tables(spark, bodies)["texts"].select("file_id", "iter_name", "rec_pos", "id", "adv_pos", "text").collect()
    return sorted(tuple(r) for r in got)


def test_forms_of_texts_and_wrapping(spark):
    rec = {"id": 5, "injected_adv": ["a", None, {"context": "b", "score": 1.0}, {"score": 2}], "question": "q"}
    one, several = {"iter_0": [rec]}, [{"iter_0": []}, {"iter_1": [{"id": "x", "injected_adv": "c"}, rec]}]
    bodies = [json.dumps(one), json.dumps(json.dumps(several)), json.dumps(several)[:-4], None, "", " ", "3", "{}", "[]", '{"iter_0": [{"question": "only"}]}']
    want = [(0, "iter_0", 0, "5", 0, "a"), (0, "iter_0", 0, "5", 2, "b"), (1, "iter_1", 0, "x", 0, "c"), (1, "iter_1", 1, "5", 0, "a"), (1, "iter_1", 1, "5", 2, "b")]
    assert texts(spark, bodies) == want


def test_children_keep_their_parents(spark):
    body = json.dumps({"iter_0": [{"id": "r0", "question": "q0"}, {"id": "r1"}], "iter_1": []})
    got = tables(spark, [body])
    assert sorted(tuple(r) for r in got["records"].select("iter_name", "rec_pos", "id", "question").collect()) == [("iter_0", 0, "r0", "q0"), ("iter_0", 1, "r1", None)]
    assert sorted(tuple(r) for r in got["iterations"].select("iter_name", "n_records").collect()) == [("iter_0", 2), ("iter_1", 0)]


def test_repeated_rows_are_files_of_their_own(spark):
    body = json.dumps({"iter_0": [{"id": "r", "injected_adv": ["a"]}]})
    df = spark.createDataFrame([(7, "c", body), (7, "c", body), (None, "c", body)], SCHEMA)
    assert shred.result_tables(df, "file_id", "body")["texts"].count() == 3


def test_empty_table(spark):
    got = shred.result_tables(spark.createDataFrame([], SCHEMA), "file_id", "body")
    assert [got[t].count() for t in ("iterations", "records", "texts")] == [0, 0, 0]


def test_nodes_hold_every_value(spark):
    body = '{"a": [1, {"b": null, "a": true}], "c": "x"}'
    nodes = shred.shred(spark.createDataFrame([(1, "", body)], SCHEMA), "file_id", "body").orderBy("node").collect()
    assert {n.root for n in nodes} == {"object"}
    assert [(n.node, n.parent, n.label, n.ordinal, n.kind, n.scalar) for n in nodes] == [
        (0, None, None, 0, "object", None), (1, 0, "a", 0, "array", None), (2, 1, None, 0, "number", "1"), (3, 1, None, 1, "object", None),
        (4, 3, "b", 0, "null", None), (5, 3, "a", 1, "bool", "true"), (6, 0, "c", 1, "string", "x"),
    ]


def test_duplicate_keys_and_deep_bodies(spark):
    deep = "[" * 100000 + "]" * 100000
    body = '{"iter_0": [{"id": "old", "id": "new", "injected_adv": ["t"]}]}'
    assert [r[3] for r in texts(spark, [body, deep])] == ["new"]


def test_rejects_have_reasons(spark):
    bodies = [None, "", " \n", '"', '{"iter_0": [', "{} {}", '{"a": NaN}', '{"a": -Infinity}', '""', '"{"', "[" * 100000, "{}"]
    got = {r.file_id: r.reason for r in tables(spark, bodies)["rejects"].collect()}
    assert got == {0: "null", 1: "empty", 2: "empty", **dict.fromkeys([3, 4, 5, 6, 7, 9, 10], "incomplete"), 8: "empty"}


def test_deep_bodies_long_numbers_and_half_pairs(spark):
    deep = "[" * 50000 + "]" * 50000
    long = "9" * 5000
    body = '{"iter_0": [{"id": %s, "x": %s, "injected_adv": ["a\\ud800b", {"context": "\\ud83d\\ude00", "y": {"z": %s}}, 1.50, true]}]}' % (long, deep, deep)
    assert texts(spark, [body, json.dumps(body)]) == [(i, "iter_0", 0, long, p, t) for i in (0, 1) for p, t in ((0, "a\ufffdb"), (1, "\U0001f600"), (2, "1.5"), (3, "true"))]


def test_deep_parser_is_the_plain_one():
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(8 if depth else 6)
        if kind < 6:
            return [None, True, False, rng.randrange(-5, 10**6), rng.random() * 10 ** rng.randrange(-9, 9), rng.choice(["", "a\"b", "é\n", "\U0001f600"])][kind]
        items = [value(depth - 1) for _ in range(rng.randrange(4))]
        return items if kind == 6 else {f"k{i % 3}": v for i, v in enumerate(items)}

    for _ in range(300):
        v = value(5)
        text = json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        assert shred.load_deep(text) == v
        for cut in {rng.randrange(len(text)) for _ in range(5)}:
            for broken in (text[:cut], text[:cut] + text[cut + 1 :], text[:cut] + rng.choice('[]{},:"1x') + text[cut:]):
                try:
                    want = json.loads(broken, parse_constant=shred._no_constant)
                except ValueError:
                    want = ValueError
                try:
                    got = shred.load_deep(broken)
                except ValueError:
                    got = ValueError
                assert got == want, broken


def test_iterations_of_one_name_stay_apart(spark):
    body = json.dumps([{"iter_0": [{"id": "a", "injected_adv": ["x"]}]}, {"iter_0": {"id": "b", "injected_adv": {"text": "y"}}}, [{"iter_0": [{"id": "no"}]}], 5])
    got = tables(spark, [body])
    records = {r.iter_pos: (r.iter_name, r.rec_pos, r.id) for r in got["records"].collect()}
    assert sorted(records.values()) == [("iter_0", 0, "a"), ("iter_0", 0, "b")]
    assert sorted((records[r.iter_pos][2], r.adv_pos, r.text) for r in got["texts"].collect()) == [("a", 0, "x"), ("b", 0, "y")]
    assert {r.iter_pos for r in got["iterations"].collect()} == set(records)


def test_few_exchanges(spark):
    body = json.dumps({"iter_0": [{"id": "r", "injected_adv": ["a"]}]})
    plan = tables(spark, [body])["texts"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6
