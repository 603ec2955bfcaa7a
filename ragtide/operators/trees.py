"""Ensembles of decision trees, fitted on every row: a task grows some trees of a forest, or a whole boosted ensemble, in NumPy."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.sources.tables import durable

#: Trees of a forest that a task grows or reads: each such task gets all rows.
BATCH = 10
#: Boosted trees as XGBoost's defaults: rate, L2 of a leaf's value, least sum of second derivatives in a child, bins of a feature, least gain.
RATE, L2, LEAST, BINS, GAIN = 0.3, 1.0, 1.0, 256, 1e-6
#: Nodes by number in their tree; a row with x <= threshold goes to ``left``, else to left + 1; feature -1 is a leaf.
NODES = {"batch": pa.int32(), "tree": pa.int32(), "node": pa.int32(), "feature": pa.int32(), "threshold": pa.float64(), "left": pa.int32(), "value": pa.float64()}
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The middle of a < b, or a where no double lies between."""
    middle = a + (b - a) / 2
    return np.where(middle < b, middle, a)


def grow(codes: np.ndarray, values: list[np.ndarray], y: np.ndarray, w: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """A classification tree by Gini impurity: feature, threshold, left, share of class 1 by node.

    ``codes``: features x rows, the place of a value among the sorted ``values`` of its feature, so a split is looked for between any two values.
    A node tries int(sqrt(features)) features drawn at random, and more while none of them has two values. Leaves are pure, of one value, or at ``depth``.
    """
    n, tried, base, level, k = len(codes), max(1, int(len(codes) ** 0.5)), 0, 0, 1
    rows, out = np.flatnonzero(w), []
    nd, packed = np.zeros(len(rows), np.int64), (w.astype(np.int64) << 1) | y
    while k:
        wr = w[rows]
        weight, ones = np.bincount(nd, wr, k), np.bincount(nd, wr * y[rows], k)
        pending = (ones > 0) & (ones < weight) & (level < depth)
        best, feature, low, high = np.full(k, -1.0), np.full(k, -1), np.zeros(k, np.int64), np.zeros(k, np.int64)
        kept = pending[nd]
        rows, nd = rows[kept], nd[kept]
        order = rng.random((k, n)).argsort(1).argsort(1)
        first = 0
        while first < n and pending.any():
            upto = first + 1 if first else tried
            for f in range(n):
                use = pending & (order[:, f] >= first) & (order[:, f] < upto)
                if not use.any():
                    continue
                of = use[nd]
                r = rows[of]
                key = (nd[of] << 38) | (codes[f, r].astype(np.int64) << 8) | packed[r]
                key.sort()
                each, group = (key & 255) >> 1, key >> 8
                at = np.flatnonzero(group[1:] != group[:-1])
                node = key[at] >> 38
                same = (key[at + 1] >> 38) == node
                at, node = at[same], node[same]
                if not len(at):
                    continue
                of_w, of_1 = np.where(use, weight, 0), np.where(use, ones, 0)  # rows of the nodes that try f, in the order of nodes
                wl = np.cumsum(each)[at] - (np.cumsum(of_w) - of_w)[node]
                pl = np.cumsum(each * (key & 1))[at] - (np.cumsum(of_1) - of_1)[node]
                gain = pl * pl / wl + (ones[node] - pl) ** 2 / (weight[node] - wl)
                starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                most, which = np.maximum.reduceat(gain, starts), node[starts]
                hit = np.flatnonzero(gain == np.repeat(most, np.diff(np.r_[starts, len(node)])))
                hit = at[hit[np.flatnonzero(np.r_[True, node[hit][1:] != node[hit][:-1]])]]
                better = most > best[which]
                b, hit = which[better], hit[better]
                best[b], feature[b] = most[better], f
                low[b], high[b] = group[hit] & 0x3FFFFFFF, group[hit + 1] & 0x3FFFFFFF
            pending, first = pending & (feature < 0), upto
        split = feature >= 0
        threshold, left, place = np.zeros(k), np.full(k, -1), np.cumsum(split) - 1
        for f in np.unique(feature[split]):
            of = feature == f
            threshold[of] = _between(values[f][low[of]], values[f][high[of]])
        left[split] = base + k + 2 * place[split]
        out.append((feature, threshold, left, ones / weight))
        kept = split[nd]
        rows, nd = rows[kept], nd[kept]
        nd = 2 * place[nd] + (codes[feature[nd], rows] > low[nd])
        base, level, k = base + k, level + 1, 2 * int(split.sum())
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def forest(x: np.ndarray, y: np.ndarray, trees: range, depth: int, seed: int) -> list[Tree]:
    """Trees of a forest, each over as many rows drawn with replacement as there are."""
    values, codes = zip(*(np.unique(c, return_inverse=True) for c in x), strict=True)
    codes, got = np.stack(codes).astype(np.int32), []
    for tree in trees:
        rng = np.random.default_rng([seed, tree])
        got.append(grow(codes, list(values), y, np.bincount(rng.integers(len(y), size=len(y)), minlength=len(y)), depth, rng))
    return got


def cuts(x: np.ndarray) -> np.ndarray:
    """Thresholds of a feature, from all its values: between any two of them where they are few, else at BINS - 1 quantiles."""
    values = np.unique(x)
    if len(values) <= BINS:
        return _between(values[:-1], values[1:])
    got = np.unique(np.sort(x)[np.arange(1, BINS) * len(x) // BINS])
    return got[got < values[-1]]


def boosted(x: np.ndarray, y: np.ndarray, trees: int, depth: int) -> list[Tree]:
    """Trees whose leaves sum up to the logit of class 1, by logistic loss and its second derivatives; the first tree has the prior in its leaves."""
    cut = [cuts(c) for c in x]
    bins = np.stack([np.searchsorted(c, v) for c, v in zip(cut, x, strict=True)]).astype(np.uint8)  # v <= c[b] in bins up to b
    allowed = np.arange(BINS) < np.array([len(c) for c in cut])[:, None]
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    prior, got = np.log(share / (1 - share)), []
    margin = np.full(len(y), prior)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        rows, nd, k, base, out = np.arange(len(y)), np.zeros(len(y), np.int64), 1, 0, []
        for level in range(depth + 1):
            gr, hr = g[rows], h[rows]
            gs, hs = np.bincount(nd, gr, k), np.bincount(nd, hr, k)
            value, feature, threshold, left, at = -RATE * gs / (hs + L2), np.full(k, -1), np.zeros(k), np.full(k, -1), np.zeros(k, np.int64)
            if level < depth:
                best = np.full(k, GAIN)
                for f in range(len(x)):
                    key = nd * BINS + bins[f, rows]
                    gl, hl = (np.bincount(key, v, k * BINS).reshape(k, BINS).cumsum(1) for v in (gr, hr))
                    gr_, hr_ = gs[:, None] - gl, hs[:, None] - hl
                    gain = gl**2 / (hl + L2) + gr_**2 / (np.maximum(hr_, 0) + L2) - (gs**2 / (hs + L2))[:, None]
                    gain = np.where(allowed[f] & (hl >= LEAST) & (hr_ >= LEAST), gain, -1.0)
                    b = gain.argmax(1)
                    most = gain[np.arange(k), b]
                    better = most > best
                    best[better], feature[better], at[better] = most[better], f, b[better]
            split = feature >= 0
            place = np.cumsum(split) - 1
            threshold[split] = [cut[f][b] for f, b in zip(feature[split], at[split], strict=True)]
            left[split] = base + k + 2 * place[split]
            out.append((feature, threshold, left, value + (prior if tree == 0 else 0.0)))
            ended = ~split[nd]
            margin[rows[ended]] += value[nd[ended]]
            rows, nd = rows[~ended], nd[~ended]
            nd = 2 * place[nd] + (bins[feature[nd], rows] > at[nd])
            base, k = base + k, 2 * int(split.sum())
            if not k:
                break
        got.append(tuple(np.concatenate(v) for v in zip(*out, strict=True)))
    return got


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The value of the leaf of each row of ``x`` (features x rows)."""
    feature, threshold, left, value = tree
    node, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
    while len(rows):
        rows = rows[feature[node[rows]] >= 0]
        at = node[rows]
        node[rows] = left[at] + (x[feature[at], rows] > threshold[at])
    return value[node]


def _matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in names])


def _grown(table: pa.Table, names: list[str], kind: str, trees: int, depth: int, seed: int) -> pa.Table:
    """A batch's trees as rows of NODES, over the rows in the order of their hash, so a fit doesn't depend on how rows arrive."""
    order = np.argsort(table["_hash"].to_numpy(), kind="stable")
    x, y = _matrix(table, names)[:, order], table["label"].to_numpy()[order].astype(np.int64)
    batch = table["batch"][0].as_py()
    mine = range(batch * BATCH, min(trees, (batch + 1) * BATCH)) if kind == "forest" else range(trees)
    made = forest(x, y, mine, depth, seed) if kind == "forest" else boosted(x, y, trees, depth)
    parts = [[np.full(len(t[0]), batch), np.full(len(t[0]), i), np.arange(len(t[0])), *t] for i, t in zip(mine, made, strict=True)]
    return pa.table([pa.array(np.concatenate(c), kind_) for c, kind_ in zip(zip(*parts, strict=True), NODES.values(), strict=True)], list(NODES))


def _summed(nodes: pa.Table, rows: pa.Table, names: list[str]) -> pa.Table:
    """_id and part: the sum of the leaves of a batch's trees."""
    x, part = _matrix(rows, names), np.zeros(len(rows))
    nodes = nodes.sort_by([("tree", "ascending"), ("node", "ascending")])
    columns, tree = [nodes[c].to_numpy() for c in ("feature", "threshold", "left", "value")], nodes["tree"].to_numpy()
    starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else []
    for a, b in zip(starts, [*starts[1:], len(tree)], strict=True):
        part += leaves(tuple(c[a:b] for c in columns), x)
    return pa.table({"_id": rows["_id"], "part": part})


class _Ensemble(Params):
    kind = Param(Params._dummy(), "kind", "forest or boosted", TypeConverters.toString)
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "most levels of splits", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of a forest's draws", TypeConverters.toInt)
    inputCols = Param(Params._dummy(), "inputCols", "features, doubles without nulls", TypeConverters.toListString)

    @property
    def getNumTrees(self) -> int:  # noqa: N802  as in Spark's ensembles
        return self.getOrDefault("numTrees")

    def batched(self, df: DataFrame) -> DataFrame:
        """``df`` once for each batch of trees, with batch."""
        batches = -(-self.getNumTrees // BATCH) if self.getOrDefault("kind") == "forest" else 1
        return df.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).repartition(4 * batches, "batch")


class Trees(Estimator, _Ensemble):
    """Fits an ensemble on all rows of its inputCols and ``label`` (0.0 or 1.0)."""

    def __init__(self, **params: object) -> None:
        super().__init__()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> TreesModel:
        names, of = self.getOrDefault("inputCols"), self.getOrDefault
        run = partial(_grown, names=names, kind=of("kind"), trees=of("numTrees"), depth=of("maxDepth"), seed=of("seed"))
        rows = self.batched(dataset.select(*names, "label", F.xxhash64(*names, "label").alias("_hash")))
        model = TreesModel()
        model.nodes = durable(rows.groupBy("batch").applyInArrow(lambda t: run(t), "batch int, tree int, node int, feature int, threshold double, left int, value double"))
        return self._copyValues(model)


class TreesModel(Model, _Ensemble, MLWritable, MLReadable):
    """A fitted ensemble; ``nodes`` is the table of its nodes."""

    nodes: DataFrame

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """``dataset`` with probability, that of class 1."""
        names = self.getOrDefault("inputCols")
        rows = durable(dataset.withColumn("_id", F.monotonically_increasing_id()))
        each = self.batched(rows.select("_id", *names))
        nodes = self.nodes.repartition(each.rdd.getNumPartitions(), "batch")
        parts = nodes.groupBy("batch").cogroup(each.groupBy("batch")).applyInArrow(lambda a, b: _summed(a, b, names), "_id bigint, part double")
        total = F.sum("part")
        told = F.round(total / self.getNumTrees if self.getOrDefault("kind") == "forest" else 1 / (1 + F.exp(-total)), 12)  # parts are summed in any order
        return rows.join(parts.groupBy("_id").agg(told.alias("probability")), "_id", "left").drop("_id")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: TreesModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.nodes.write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def load(self, path: str) -> TreesModel:
        model, told = TreesModel(), DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(model, told)
        model.nodes = self.sparkSession.read.parquet(f"{path}/nodes")
        return model
