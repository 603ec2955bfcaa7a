import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragtide.operators import mlfilter, providers
from ragtide.sources import discovery, files, reports
from ragtide.sources.tables import discard, durable, release


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_paths(spark, tmp_path):
    for name in ("b-nq.json", "a-nq.json", "c.json", "d-nq.txt"):
        put(tmp_path / name, "{}")
    given = (f"file:{tmp_path}/c.json", "elsewhere.json", f"file:{tmp_path}/c.json")
    got = [r.path.rsplit("/", 1)[-1] for r in discovery.paths(spark, str(tmp_path), "nq", given).orderBy("place").collect()]
    assert got == ["c.json", "elsewhere.json", "a-nq.json", "b-nq.json"]
    assert discovery.paths(spark).count() == 0


def test_runs_and_artifacts(spark, tmp_path):
    for day, kind, anchor, q in ((1, "E0", None, "q1"), (2, "E0", None, "q1"), (1, "E1", "nearest", "q1"), (3, "E1", "nearest", "q2")):
        put(tmp_path / f"2025010{day}_000000_oracle_{kind}_{anchor}_{q}" / "run_config.json", json.dumps({"intervention": kind, "anchor_strategy": anchor}, indent=1))
    got = {(r.query_id, r.intervention): r.path.rsplit("/", 1)[-1] for r in discovery.sweep_runs(spark, str(tmp_path)).collect()}
    assert got == {("q1", "E0"): "20250102_000000_oracle_E0_None_q1", ("q1", "E1-nearest"): "20250101_000000_oracle_E1_nearest_q1", ("q2", "E1-nearest"): "20250103_000000_oracle_E1_nearest_q2"}
    assert discovery.latest_artifact(spark, str(tmp_path), "_E0_", "run_config.json").endswith("20250102_000000_oracle_E0_None_q1/run_config.json")
    assert discovery.latest_artifact(spark, str(tmp_path), "none", "run_config.json") is None


def test_matrices(spark, tmp_path):
    for name, value in (("transformed_M_alpha0.3.npy", 0.3), ("transformed_M_alpha1.0.npy", 1.0), ("original_M.npy", 9.0), ("other.npy", 5.0)):
        (tmp_path / "a").mkdir(exist_ok=True)
        np.save(tmp_path / "a" / name, np.full((2, 2), value))
    (tmp_path / "b").mkdir()
    np.save(tmp_path / "b" / "original_M.npy", np.eye(2, dtype="f4"))
    got = discovery.matrices(spark, str(tmp_path))
    assert {(r.run[-1], r.alpha, r.i, r.j, r.sim) for r in got.collect()} == {("a", v, i, j, v) for v in (0.3, 1.0) for i in (0, 1) for j in (0, 1)} | {("b", 1.0, i, j, float(i == j)) for i in (0, 1) for j in (0, 1)}
    asked = spark.createDataFrame([("a", 1 - 0.7), ("a", 0.5)], "run string, alpha double").withColumn("run", F.concat(F.lit("x"), "run"))
    joined = discovery.rounded_join(asked, got.withColumn("run", F.concat(F.lit("x"), F.substring("run", -1, 1))), ["run"], "alpha")
    assert sorted((round(r.alpha, 6), r.sim) for r in joined.where("i is null or i = j").collect()) == [(0.3, 0.3), (0.3, 0.3), (0.5, None)]


def test_examples_and_shards(spark, tmp_path):
    rows = [{"question": f"q{i}", "positive_ctxs": [{"title": "", "text": f"g{i}"}], "negative_ctxs": [{"title": "t", "text": str(j)} for j in range(3)]} for i in range(7)]
    put(tmp_path / "a.jsonl", "\n".join(map(json.dumps, rows[:4])) + "\n")
    put(tmp_path / "b.json", json.dumps(rows[4:], indent=1))
    paths = [str(tmp_path / "a.jsonl"), str(tmp_path / "b.json")]
    every = {r.counter: r.question for r in discovery.fine_tuning(spark, paths).collect()}
    assert every == {i + 1: f"q{i}" for i in range(7)}
    assert sorted(r.question for r in discovery.fine_tuning(spark, paths, rank=1, world=3).collect()) == ["q0", "q3", "q6"]
    assert sorted(r.question for r in discovery.fine_tuning(spark, paths, most=5).collect()) == ["q0", "q1", "q2", "q3", "q4"]
    got = discovery.with_negatives(discovery.fine_tuning(spark, paths), "counter", 2).collect()
    assert all(r.gold == f"g{r.counter - 1}" and len(set(r.negatives)) == 2 and set(r.negatives) <= {"t 0", "t 1", "t 2"} for r in got)
    assert len({tuple(r.negatives) for r in got}) > 1


def test_hard_negatives(spark):
    ctx = lambda *t: [{"title": None, "text": x} for x in t]
    rows = [(1, "q", ctx("g", "h"), ctx("n0", "n1"), ctx("a", "b", "c")), (2, "q", None, None, None)]
    df = spark.createDataFrame(rows, f"id int, {discovery.EXAMPLE}")
    plain = {r.id: r for r in discovery.with_negatives(df, "id", 4, hard_ratio=1.0, hard_from=1, evaluate=True).collect()}
    assert plain[1].gold == "g" and list(plain[1].negatives) == ["b", "c", "n0", "n1"]
    assert plain[2].gold is None and list(plain[2].negatives) == []
    assert list(discovery.with_negatives(df, "id", 0).orderBy("id").first().negatives) == []


def test_collections_and_indexes(spark, tmp_path):
    put(tmp_path / "corpus.jsonl", '{"_id": "d", "title": "t", "text": "x"}\n')
    put(tmp_path / "queries.jsonl", '{"_id": "q", "text": "y"}\n')
    for split in ("test", "train"):
        put(tmp_path / "qrels" / f"{split}.tsv", f"query-id\tcorpus-id\tscore\nq\t{split}\t1\n")
    docs = lambda *a: sorted(r.doc_id for r in files.corpus(spark, str(tmp_path), *a)["qrels"].collect())
    assert docs() == ["test", "train"] and docs("nq") == ["test"] and docs("nq", "train") == docs("msmarco") == ["train"]
    with pytest.raises(ValueError, match="no such collection"):
        docs("other")
    put(tmp_path / "many.json", '[{"a": 1},\n {"a": 2, "b": "x"}]')
    assert sorted(files.documents(spark, str(tmp_path / "many.json"), "a int, b string").collect()) == [(1, None), (2, "x")]
    v = spark.createDataFrame([(2, [0.5, 1.0]), (1, [1.0, 0.0]), (3, None)], "vec_id bigint, v array<float>")
    files.write_index(v, str(tmp_path / "index"), "vec_id", "v", {"metric": "dot"}, 2)
    got, about = files.read_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, got.collect())) == [(1, [1.0, 0.0]), (2, [0.5, 1.0])] and about == {"id": "vec_id", "vector": "v", "rows": 2, "width": 2, "metric": "dot"}
    files.write_config(spark, {"k": 5}, str(tmp_path / "config"), [str(tmp_path / "corpus.jsonl")])
    told = spark.read.schema("config string, md5 string, length bigint").json(str(tmp_path / "config")).collect()
    assert {(r.config, r.length, len(r.md5)) for r in told} == {('{"k": 5}', None, 32), (None, 40, 32)}


def test_saved_models(spark, tmp_path):
    rows = [(*[float(i % 2 + j) for j in range(len(mlfilter.FEATURES))], i % 2 == 1) for i in range(40)]
    df = spark.createDataFrame(rows, [*mlfilter.FEATURES, "is_poison"])
    model = mlfilter.fit(df, trees=3)
    mlfilter.save(model, str(tmp_path / "m"), spark, "forest", {"rows": 40})
    again, about = mlfilter.load(str(tmp_path / "m"), spark)
    assert about["model_type"] == "forest" and about["training_meta"] == {"rows": 40}
    key = lambda r: tuple(r)[: len(mlfilter.FEATURES)]
    assert [r.probability for r in sorted(mlfilter.score(again, df).collect(), key=key)] == [r.probability for r in sorted(mlfilter.score(model, df).collect(), key=key)]
    with pytest.raises(FileNotFoundError):
        mlfilter.load(str(tmp_path / "none"), spark)
    with pytest.raises(ValueError, match="path is needed"):
        mlfilter.load("", spark)
    spark.createDataFrame([('{"model_type": "forest"}',)], "value string").coalesce(1).write.mode("overwrite").text(str(tmp_path / "m" / "about"))
    with pytest.raises(ValueError, match="does not say its feature_names"):
        mlfilter.load(str(tmp_path / "m"), spark)


def test_providers_by_name(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "text string")
    got = providers.create({"kind": "embedding", "name": "hashed", "params": {"text": "text", "size": 8}})(df).collect()
    assert [round(sum(x * x for x in r.embedding), 6) for r in got] == [1.0, 0.0, 0.0] and got[0].notes == "embedding: hashed proxy"
    providers.register("answer", "own", lambda d: d.withColumn("slm_answer", F.lit("x")))
    assert providers.create({"kind": "answer", "name": "own"})(df).first().slm_answer == "x"
    with pytest.raises(ValueError, match="no answer provider gpt"):
        providers.create({"kind": "answer", "name": "gpt"})


def test_texts_of_findings(spark):
    names = ["dataset", "model", "defense", *[n for n, _ in reports.TOLD]]
    text = reports.decision_text(spark.createDataFrame([("nq", "m", "d", True, False, None, False, False, False), ("nq", "m", "e", False, False, False, False, False, False)], ", ".join(f"{n} {'string' if i < 3 else 'boolean'}" for i, n in enumerate(names))))
    assert "less than half" in text and "Unknown: many_false_positives." in text and "Nothing stands out." in text
    rows = spark.createDataFrame([("clean_kept", 1, 7, 0, False, 0.1, None, 9)], "category string, place int, record_id int, rank int, is_poison boolean, filterrag_score double, query_only_score double, found int")
    assert "## clean kept (1 of 9)" in reports.example_text(rows)


def test_intermediates_are_discarded(spark, tmp_path):
    first = durable(spark.range(3).toDF("id"))
    gone = first.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    df = durable(first)
    release(first)
    release(df.select("id"))  # no durable table itself
    assert df.count() == 3
    path = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    import os

    assert os.path.exists(path) and not os.path.exists(gone)
    discard(spark)
    assert not os.path.exists(path)
