"""Nested JSON bodies as an adjacency table, and flat entity tables pivoted from it.

Every JSON value becomes one row (node): its parent, its label in an object, its ordinal in its parent, its kind
and, for scalars, its text. Entities are object nodes joined with their scalar children, one column for each
wanted label, with the key of the parent node kept on every child.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.sources.tables import durable, spread

NODE = "node bigint, parent bigint, depth int, label string, ordinal bigint, kind string, scalar string, root string"
SCALARS = ("string", "number", "bool")
#: Kind of the one row that a body without nodes gives; its scalar is the reason.
REJECT = "reject"
#: Labels under which an injected text that is stored as an object keeps its text, the first present one counts.
TEXT_LABELS = ("context", "text", "content", "passage")
#: Integers of more digits stay text, as Python converts no longer ones.
DIGITS = 4000
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
BLANK = re.compile(r"[ \t\n\r]*")


class Digits(str):
    """A number that is kept as it is written."""


def _integer(text: str) -> int | Digits:
    return int(text) if len(text) <= DIGITS else Digits(text)


def _no_constant(text: str) -> None:
    raise ValueError(f"{text} is not JSON")


def _scalar(value: object) -> tuple[str, str | None]:
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "bool", "true" if value else "false"
    if isinstance(value, Digits):
        return "number", str(value)
    if isinstance(value, str):
        return "string", _whole(value)
    return "number", str(value) if isinstance(value, int) else repr(value)


def _whole(text: str) -> str:
    """``text`` with halves of surrogate pairs, which no encoding holds, replaced by the replacement character."""
    if text.isascii():
        return text
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def load_deep(text: str) -> object:
    """The value of complete JSON nested to any depth, by an own stack; as ``json.loads`` otherwise. ValueError if it is incomplete."""
    skip = lambda i: BLANK.match(text, i).end()
    stack: list[tuple[object, str | None]] = []  # open containers, and the key that waits for its value
    i, value, done = skip(0), None, False

    def key_at(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError("a key is missing")
        name, i = scanstring(text, i + 1)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("a colon is missing")
        return name, skip(i + 1)

    while True:
        if not done:  # a value begins at i
            c = text[i : i + 1]
            if c in ("[", "{"):
                close, held = ("]", []) if c == "[" else ("}", {})
                i = skip(i + 1)
                if text[i : i + 1] != close:
                    name = None
                    if c == "{":
                        name, i = key_at(i)
                    stack.append((held, name))
                    continue
                value, i = held, i + 1
            elif c == '"':
                value, i = scanstring(text, i + 1)
            elif word := next((w for w in ("true", "false", "null") if text.startswith(w, i)), None):
                value, i = {"true": True, "false": False, "null": None}[word], i + len(word)
            else:
                m = NUMBER.match(text, i)
                if not m:
                    raise ValueError(f"no value at {i}")
                value, i = float(m[0]) if m[1] or m[2] else _integer(m[0]), m.end()
            done = True
        i = skip(i)
        if not stack:
            if i != len(text):
                raise ValueError("more than one value")
            return value
        held, name = stack.pop()
        if name is None:
            held.append(value)
        else:
            held[name] = value
        c, i = text[i : i + 1], i + 1
        if c == ",":
            i, name = skip(i), None
            if isinstance(held, dict):
                name, i = key_at(i)
            stack.append((held, name))
            done = False
        elif c == ("]" if isinstance(held, list) else "}"):
            value = held
        else:
            raise ValueError("a comma or an end is missing")


def parse(body: str | None) -> object:
    """The JSON value of a body, however often it is wrapped in a JSON string; ValueError, with the reason, if it isn't complete JSON.

    NaN and infinities are no JSON. Nesting has no limit, nor has the length of an integer.
    """
    if body is None:
        raise ValueError("null")
    value: object = body
    while isinstance(value, str):
        text = value.lstrip("\ufeff")
        if not text.strip(" \t\n\r"):
            raise ValueError("empty")
        try:
            value = json.loads(text, parse_int=_integer, parse_constant=_no_constant)
        except RecursionError:
            try:
                value = load_deep(text)
            except ValueError:
                raise ValueError("incomplete") from None
        except ValueError:
            raise ValueError("incomplete") from None
        if isinstance(value, Digits):
            break
    return value


def walk(value: object, keep: frozenset[str] | None = None) -> Iterator[tuple]:
    """Nodes of a value in document order; scalars of labels outside ``keep`` are left out (their ordinals stay)."""
    root = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "scalar"
    stack, n = [(value, None, 0, None, 0)], 0
    while stack:
        v, parent, depth, label, ordinal = stack.pop()
        if isinstance(v, dict):
            yield n, parent, depth, label, ordinal, "object", None, root
            stack += [(x, n, depth + 1, _whole(k), i) for i, (k, x) in reversed(list(enumerate(v.items())))]
        elif isinstance(v, list):
            yield n, parent, depth, label, ordinal, "array", None, root
            stack += [(x, n, depth + 1, None, i) for i, x in reversed(list(enumerate(v)))]
        elif keep is None or label is None or label in keep:
            yield n, parent, depth, label, ordinal, *_scalar(v), root
        n += 1


def shred(df: DataFrame, key: str, body: str, keep: list[str] | None = None) -> DataFrame:
    """The adjacency table of ``body``: tree (one for each row), ``key``, node, parent, depth, label, ordinal, kind, scalar, root (the kind of its root).

    Node numbers rise in document order from 0, the root, whose parent is null. A body that is null, empty or no complete JSON gives one row
    of kind REJECT without a node, with the reason (null, empty, incomplete) as its scalar; of repeated object keys the last counts. Nesting and numbers have no
    limit; numbers keep their digits, halves of surrogate pairs become the replacement character. Repeated rows
    are trees of their own. ``keep`` prunes scalars of other labels before anything is shuffled or written.
    Returned from a durable table, as entities are self-joins of it.
    """
    kept, kind = frozenset(keep) if keep is not None else None, df.schema[key].dataType.simpleString()
    text = pa.string()
    schema = pa.schema([("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("label", text), ("ordinal", pa.int64()), ("kind", text), ("scalar", text), ("root", text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(2)):
                before = len(rows)
                try:
                    rows += walk(parse(text.as_py()), kept)
                except ValueError as e:
                    rows.append((None, None, None, None, None, REJECT, str(e), None))
                at += [i] * (len(rows) - before)
                if len(rows) > 200_000:
                    yield _batch(batch, at, rows, schema)
                    at, rows = [], []
            yield _batch(batch, at, rows, schema)

    trees = spread(df.select(F.col(key).alias("_key"), F.col(body).cast("string").alias("_body"))).select(F.monotonically_increasing_id().alias("tree"), "_key", "_body")
    return durable(trees.mapInArrow(run, f"tree bigint, _key {kind}, {NODE}").withColumnRenamed("_key", key))


def _batch(batch: pa.RecordBatch, at: list[int], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    index = pa.array(at, pa.int64())
    columns = [batch.column(0).take(index), batch.column(1).take(index)]
    columns += [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["tree", "_key", *schema.names])


def rejects(nodes: DataFrame, key: str) -> DataFrame:
    """(tree, ``key``, reason) of every body that has no nodes."""
    return nodes.where(F.col("kind") == REJECT).select("tree", key, F.col("scalar").alias("reason"))


OWN = ("parent", "depth", "label", "ordinal", "root")


def entities(nodes: DataFrame, key: str, labels: list[str], carried: list[str] | None = None) -> DataFrame:
    """One row for each object node: tree, ``key``, node, OWN, a column for each of ``labels``, and a struct for each of ``carried``.

    The join of object nodes with their children and the pivot in one aggregate: an object brings itself, every child of a wanted
    label itself to its parent. A label's column is the text of the scalar child of that label (null without one); a carried label's is its child's
    (node, kind, scalar), whatever it is.
    """
    carried = carried or []
    child = F.col("label").isin(*labels) & F.col("kind").isin(*SCALARS) | F.col("label").isin(*carried)
    me = F.struct(*[F.col(c) for c in OWN])
    each = nodes.where((F.col("kind") == "object") | child).select(
        "tree", key, F.explode(F.filter(F.array(
            F.when(F.col("kind") == "object", F.struct(F.col("node").alias("of"), me.alias("me"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("scalar"), F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("string").alias("kind"))),
            F.when(child, F.struct(F.col("parent").alias("of"), F.lit(None).cast(nodes.select(me).schema[0].dataType).alias("me"), F.col("label").alias("label"), F.col("scalar").alias("scalar"), F.col("node").alias("node"), F.col("kind").alias("kind"))),
        ), lambda x: x.isNotNull())).alias("x"),
    )
    mine = [F.max(f"x.me.{c}").alias(c) for c in OWN]
    columns = [F.max(F.when(F.col("x.label") == name, F.col("x.scalar"))).alias(name) for name in labels]
    holders = [F.max(F.when(F.col("x.label") == name, F.struct("x.node", "x.kind", "x.scalar"))).alias(f"_{name}") for name in carried]
    return each.groupBy("tree", key, F.col("x.of").alias("node")).agg(*mine, *columns, *holders).where("root is not null")


def result_tables(files: DataFrame, key: str, body: str, fields: list[str] | None = None) -> dict[str, DataFrame]:
    """Flat tables of result files: iterations, records, texts and rejects, every child with the keys of its parent.

    A body is an object, or a list of objects, of iterations; an iteration is a list of records (a single record
    object counts as a list of one). ``fields`` are the scalar fields kept on records besides id.
    iterations: ``key``, iter_pos, iter_name, n_records. records: ``key``, iter_pos, iter_name, rec_pos, id, the fields.
    texts: ``key``, iter_pos, iter_name, rec_pos, id, adv_pos, text, for each text of injected_adv in whatever form it is stored.
    iter_pos is the node of the iteration, so that iterations of one name in a body stay apart; rejects: ``key``, reason.
    All have tree, so that rows of files of one key stay apart.
    """
    fields = ["id", *(fields or [])]
    nodes = shred(files, key, body, [*fields, "injected_adv", *TEXT_LABELS])
    things = entities(nodes, key, fields, ["injected_adv"])
    # a label shows that the parent is an object: the root itself, or an object in the root array
    names_iteration = F.col("label").isNotNull() & ((F.col("depth") == 1) & (F.col("root") == "object") | (F.col("depth") == 2) & (F.col("root") == "array"))
    iterations = nodes.where(F.col("kind").isin("array", "object") & names_iteration).select("tree", key, F.col("node").alias("iter_pos"), F.col("label").alias("iter_name"), "kind")
    at = F.when(F.col("label").isNull(), F.col("parent")).otherwise(F.col("node"))  # a record in a list, or an iteration that is one itself
    maybe = things.where(F.col("label").isNull() & F.col("depth").between(2, 3) | names_iteration).withColumn("iter_pos", at).withColumn("rec_pos", F.when(F.col("label").isNull(), F.col("ordinal")).otherwise(F.lit(0)))
    records = maybe.join(iterations.select("tree", "iter_pos", "iter_name"), ["tree", "iter_pos"])
    link = ["tree", key, "iter_pos", "iter_name", "rec_pos", "id"]
    carriers = records.select(*link, "_injected_adv.node", "_injected_adv.kind", "_injected_adv.scalar").where("kind <> 'null'")
    # a text is an element of the carrier, or the carrier itself; it is a scalar, or an object that keeps it under a text label
    held = entities(nodes, key, list(TEXT_LABELS)).where("label is null or label = 'injected_adv'").select("tree", "parent", "node", "label", F.col("ordinal").alias("adv_pos"), F.coalesce(*TEXT_LABELS).alias("text")).where("text is not null")
    bare = nodes.where(F.col("label").isNull() & F.col("kind").isin(*SCALARS)).select("tree", "parent", F.col("ordinal").alias("adv_pos"), F.col("scalar").alias("text"))
    # an element is found by its list, an object that is the carrier by itself
    own = held.where("label is not null").select("tree", F.col("node").alias("at"), F.lit(0).cast("bigint").alias("adv_pos"), "text")
    offered = held.where("label is null").select("tree", F.col("parent").alias("at"), "adv_pos", "text").unionByName(own).unionByName(bare.select("tree", F.col("parent").alias("at"), "adv_pos", "text"))
    found = carriers.where("kind in ('array', 'object')").withColumnRenamed("node", "at").join(offered, ["tree", "at"]).select(*link, "adv_pos", "text")
    single = carriers.where(F.col("kind").isin(*SCALARS)).select(*link, F.lit(0).cast("bigint").alias("adv_pos"), F.col("scalar").alias("text"))
    counted = records.groupBy("tree", "iter_pos").agg(F.count("*").alias("n_records"))
    return {
        "iterations": iterations.join(counted, ["tree", "iter_pos"], "left").select("tree", key, "iter_pos", "iter_name", F.coalesce("n_records", F.lit(0)).cast("bigint").alias("n_records")),
        "records": records.select("tree", key, "iter_pos", "iter_name", "rec_pos", *fields),
        "texts": found.unionByName(single),
        "rejects": rejects(nodes, key),
    }
