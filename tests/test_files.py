import json

import numpy as np

from ragtide.operators import mlfilter, retrieval, transforms
from ragtide.sources import files, reports
from ragtide.streaming import summaries


def test_result_files_and_runs(spark, tmp_path):
    rec = {"id": "t", "question": "q", "injected_adv": ["a"], "defense": "none"}
    (tmp_path / "a.json").write_text(json.dumps([{"iter_0": [rec, rec]}]))
    (tmp_path / "b.json").write_text(json.dumps({"iter_0": [rec]}))
    assert files.results(spark, str(tmp_path / "*.json")).count() == 3
    (tmp_path / "run.txt").write_text(json.dumps({"q": {"a": 1.0, "b": 2.0}}))
    assert [(r.doc_id, r["rank"]) for r in files.run(spark, str(tmp_path / "run.txt")).orderBy("rank").collect()] == [("b", 0), ("a", 1)]
    (tmp_path / "targets.txt").write_text(json.dumps({"x": {"id": "x", "question": "q", "correct answer": "c", "incorrect answer": "i", "adv_texts": ["t"]}}))
    assert files.targets(spark, str(tmp_path / "targets.txt")).first()["correct answer"] == "c"


def test_diagnostics_of_an_older_schema(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"query_id": "q", "k": 5}\n\n{"query_id": "r", "k": 5, "asr_no_defense_strict": true}\n')
    got = files.diagnostics(spark, str(tmp_path / "d.jsonl"))
    assert got.count() == 2
    assert files.missing_fields(got) == []
    assert files.missing_fields(got.drop("notes")) == ["notes"]


def test_csv_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double")
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(r.v for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()) == ["0.5000", "None"]
    assert "| a | 0.5000 |" in reports.markdown(df, "t")


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "vec_id bigint, embedding array<double>")
    got = retrieval.top_k(df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), df.withColumnRenamed("vec_id", "doc_id"), 5, "dot", skip_self=True).collect()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for q in range(0, 300, 50):
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == np.argsort(-s[q])[:5].tolist()


def test_approximate_search_recall(spark, data):
    from ragtide.plans import catalogue

    exact = {(r.query_id, r.doc_id) for r in catalogue.QUERIES["topk_cosine"](spark, data).collect()}
    near = {(r.query_id, r.doc_id) for r in catalogue.QUERIES["lsh_topk"](spark, data).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_transforms_leave_all_in_place_at_zero():
    rng = np.random.default_rng(2)
    p, c = transforms.unit_rows(rng.normal(size=(4, 6))), transforms.unit_rows(rng.normal(size=(5, 6)))
    for got in (transforms.coral_pca(p, c, 0), transforms.coral_ridge(p, c, 0), transforms.mmd_descent(p, c, 0), transforms.anchor_interpolate(p, c, 1)):
        assert np.allclose(got, p)
    assert np.allclose(np.linalg.norm(transforms.coral_pca(p, c, 0.5), axis=1), 1)
    assert sorted(transforms.anchors(p, c, "farthest")) == [0, 1, 2, 3]


def test_filter_learns(spark):
    rng = np.random.default_rng(3)
    rows = [(*[float(v) for v in rng.normal(size=len(mlfilter.FEATURES)) + 3 * (i % 2)], bool(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in mlfilter.FEATURES) + ", is_poison boolean")
    got = mlfilter.score(mlfilter.fit(df, trees=5), df)
    assert got.where("(probability >= 0.5) = is_poison").count() > 190


def test_stream_equals_batch(spark, data):
    table = spark.read.parquet(f"{data}/diagnostics.parquet")
    stream = summaries.read_stream(spark, f"{data}/diagnostics*.parquet", table.schema)
    got = summaries.run_to_table(summaries.running_summary(stream), "complete")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in summaries.running_summary(table).collect()}
    closed = summaries.run_to_table(summaries.windowed_counts(stream, late="1 hour"), "append")
    assert closed.columns == ["window_start", "defense", "n", "removed_poison"]
    every = {tuple(r) for r in summaries.run_to_table(summaries.windowed_counts(stream, late="36500 days"), "complete").collect()}
    assert {tuple(r) for r in closed.collect()} <= every and every


def test_stream_of_nothing(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/diagnostics.parquet").schema
    assert summaries.run_to_table(summaries.running_summary(summaries.read_stream(spark, str(tmp_path), schema)), "complete").count() == 0
