import math
import os
import unicodedata

import duckdb
import pytest

import __spark_entry__ as entry
from ragtide.plans import catalogue

@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def canonical(rows):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    want = [[r[names.index(c)] for c in columns] for r in got.fetchall()]
    assert canonical(tuple(r[c] for c in columns) for r in df.collect()) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_values_without_sql(spark, data, name):
    rows = catalogue.QUERIES[name](spark, data).collect()
    assert rows
    assert not any(isinstance(v, float) and (math.isnan(v) or math.isinf(v)) for r in rows for v in r)


def test_decomposed_texts(spark, data):
    plain = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.text_nfd for r in catalogue.QUERIES["nfd_normalize"](spark, data).collect()}
    assert got == {k: None if v is None else unicodedata.normalize("NFD", v) for k, v in plain.items()}


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
