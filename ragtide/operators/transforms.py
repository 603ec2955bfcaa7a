"""Dense transforms of the poisoned vectors of one retrieved set (at most k rows a group), in NumPy.

A group is a query's retrieved passages, so its size is bounded by k; groups are independent and shuffle once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.functions import vectors as V


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


#: Fixed value: a variance up to this is no direction.
FLOOR = 1e-8


def _directions(centred: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances and directions (rows) of the ``rank`` largest principal axes."""
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    return (s**2 / (len(centred) - 1))[:rank], v[:rank]


def _two_each(poison: np.ndarray, clean: np.ndarray) -> None:
    if len(poison) < 2 or len(clean) < 2:
        raise ValueError(f"a covariance needs two rows on either side, there are {len(poison)} and {len(clean)}")


def _mixed(poison: np.ndarray, recoloured: np.ndarray, beta: float) -> np.ndarray:
    return unit_rows((1 - beta) * poison + beta * recoloured)


def coral_pca(poison: np.ndarray, clean: np.ndarray, beta: float, rank: int | None = None) -> np.ndarray:
    """Poisoned vectors whitened and recoloured to the clean covariance in the shared subspace, moved to the clean mean, and mixed in by ``beta``.

    The subspace has as many directions as both sides have (rows less one), or ``rank`` of them at most. At beta 0 the unit vectors; fewer than two rows on either side raise.
    """
    _two_each(poison, clean)
    if rank is not None and rank < 0:
        raise ValueError("rank must not be negative")
    shared = min(len(poison), len(clean)) - 1
    shared = shared if rank is None else min(rank, shared)
    off = poison - poison.mean(0)
    (w, u), (c, v) = _directions(off, shared), _directions(clean - clean.mean(0), shared)
    back = np.where(w > FLOOR, 1 / np.sqrt(np.where(w > FLOOR, w, 1)), 0)
    coloured = off @ (u.T * back) @ u @ (v.T * np.sqrt(np.maximum(c, 0))) @ v
    return _mixed(poison, coloured + clean.mean(0), beta)


def coral_ridge(poison: np.ndarray, clean: np.ndarray, beta: float, ridge: float = 0.1) -> np.ndarray:
    """The same with covariances plus ``ridge`` on the diagonal, over all directions; ridge must be positive."""
    if ridge <= 0:
        raise ValueError("ridge must be positive")
    _two_each(poison, clean)
    eye = np.eye(poison.shape[1]) * ridge

    def power(x: np.ndarray, p: float) -> np.ndarray:
        w, q = np.linalg.eigh(np.cov(x.T) + eye)
        return (q * np.maximum(w, FLOOR) ** p) @ q.T

    return _mixed(poison, (poison - poison.mean(0)) @ power(poison, -0.5) @ power(clean, 0.5) + clean.mean(0), beta)


def mmd_trace(poison: np.ndarray, clean: np.ndarray, steps: int, rate: float = 0.05, keep: float = 0.1, gamma: float = 1.0) -> list[tuple[np.ndarray, float, float, float]]:
    """steps + 1 states (vectors, discrepancy, preservation, loss) of poisoned vectors that move down the gradient of their loss on the unit sphere.

    The loss is the squared RBF discrepancy to the clean vectors plus ``keep`` times the mean squared displacement. Both sides are brought
    to unit length first, so the first state is the unit vectors. An empty side, or a parameter out of range, raises.
    """
    if not len(poison) or not len(clean):
        raise ValueError("a discrepancy needs a row on either side")
    if steps < 0 or rate <= 0 or gamma <= 0:
        raise ValueError("steps must not be negative, rate and gamma must be positive")
    start, fixed = unit_rows(poison), unit_rows(clean)
    z, n, m = start.copy(), len(poison), len(clean)
    among = float(np.exp(-gamma * ((fixed[:, None] - fixed[None]) ** 2).sum(-1)).mean())
    states = []
    for step in range(steps + 1):
        own, far = z[:, None] - z[None], z[:, None] - fixed[None]
        k_own, k_far = np.exp(-gamma * (own**2).sum(-1)), np.exp(-gamma * (far**2).sum(-1))
        mmd, kept = float(k_own.mean() + among - 2 * k_far.mean()), float(((z - start) ** 2).sum(1).mean())
        states.append((z, mmd, kept, mmd + keep * kept))
        if step < steps:
            grad = -4 * gamma * (k_own[..., None] * own).sum(1) / n**2 + 4 * gamma * (k_far[..., None] * far).sum(1) / (n * m) + 2 * keep * (z - start) / n
            z = unit_rows(z - rate * grad)
    return states


def mmd_descent(poison: np.ndarray, clean: np.ndarray, steps: int, rate: float = 0.05, keep: float = 0.1, gamma: float = 1.0) -> np.ndarray:
    """The last state of ``mmd_trace``."""
    return mmd_trace(poison, clean, steps, rate, keep, gamma)[-1][0]


def assign(cost: np.ndarray) -> np.ndarray:
    """For each row a column of its own, so that the total cost is least (Hungarian method); there are as many columns as rows at least."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.int64)  # owner: the row of each column, from 1; column 0 holds the row that is placed
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while owner[j]:
            used[j] = True
            left = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = ~used[1:] & (left < least[1:])
            least[1:][better], way[1:][better] = left[better], j
            to = int(np.where(used, np.inf, least)[1:].argmin()) + 1
            step = least[to]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j = to
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    got = np.empty(n, np.int64)
    held = np.flatnonzero(owner[1:])
    got[owner[1:][held] - 1] = held
    return got


STRATEGIES = ("rank_aligned", "nearest", "farthest", "random")


def anchors(poison: np.ndarray, clean: np.ndarray, strategy: str, every: bool = False, seed: int = 12) -> np.ndarray:
    """For each poisoned row the clean row that it is tied to: rank_aligned, the choice of most (nearest) or least (farthest) total cosine, or random by ``seed``.

    One-to-one, among the first clean rows, as many as there are poisoned ones, or ``every`` one. Where there are fewer
    clean rows than poisoned ones, each is offered equally often: as often as is needed, and none exists one-to-one.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no such anchor strategy: {strategy}")
    n = len(poison)
    if not n or not len(clean):
        return np.zeros(n, np.int64)
    offered = np.tile(np.arange(len(clean)), -(-n // len(clean)))
    if not every and n <= len(clean):
        offered = offered[:n]
    if strategy == "rank_aligned":
        return offered[:n]
    if strategy == "random":
        return np.random.default_rng(seed).permutation(offered)[:n]
    sim = unit_rows(poison) @ unit_rows(clean[offered]).T
    return offered[assign(-sim if strategy == "nearest" else sim)]


def anchor_interpolate(poison: np.ndarray, clean: np.ndarray, alpha: float, strategy: str = "rank_aligned", every: bool = True, seed: int = 12) -> np.ndarray:
    """Poisoned vectors moved towards their anchors: alpha z + (1 - alpha) anchor, at unit length; the unit vectors where there are no clean ones."""
    if not len(clean):
        return unit_rows(poison)
    return unit_rows(alpha * poison + (1 - alpha) * clean[anchors(poison, clean, strategy, every, seed)])


def by_group(passages: DataFrame, keys: list[str], params: list[tuple], move: Callable[..., np.ndarray], names: tuple[str, ...], least: int = 1) -> DataFrame:
    """``passages`` (keys, doc_id, rank, is_poison, embedding) for every setting of ``names``, with the poisoned vectors moved; original has the one before.

    Groups with fewer than ``least`` poisoned or clean rows, over which a transform is not defined, keep their vectors; moved is false for them.
    """
    kinds = ", ".join(f"{k} {passages.schema[k].dataType.simpleString()}" for k in keys)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank")
        x, p = np.array(f["embedding"].tolist(), np.float64), f["is_poison"].to_numpy(bool)
        out = []
        for values in params:
            y, fits = x.copy(), min(p.sum(), (~p).sum()) >= least
            if fits:
                y[p] = move(x[p], x[~p], *values)
            out.append(f.assign(embedding=list(y), original=list(x), moved=bool(fits), **dict(zip(names, values, strict=True))))
        return pd.concat(out)

    given = passages.select(*keys, "doc_id", "rank", "is_poison", V.doubles(F.col("embedding")).alias("embedding"))
    doc, rank = (passages.schema[c].dataType.simpleString() for c in ("doc_id", "rank"))
    settings = ", ".join(f"{name} {'string' if isinstance(value, str) else 'double'}" for name, value in zip(names, params[0], strict=True))
    return given.groupBy(*keys).applyInPandas(run, f"{kinds}, doc_id {doc}, rank {rank}, is_poison boolean, embedding array<double>, original array<double>, moved boolean, {settings}")


def pca_coordinates(passages: DataFrame, keys: list[str]) -> DataFrame:
    """Two principal coordinates of each passage within its group, signs set so that the largest entry is positive; zeros for one row."""
    kinds = ", ".join(f"{k} {passages.schema[k].dataType.simpleString()}" for k in keys)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = np.array(f["embedding"].tolist(), np.float64)
        xy = np.zeros((len(x), 2))
        if len(x) > 1:
            u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
            got = (u * s)[:, :2]
            got = got * np.where(got[np.abs(got).argmax(0), range(got.shape[1])] < 0, -1, 1)
            xy[:, : got.shape[1]] = got
        return f[[*keys, "doc_id"]].assign(x=xy[:, 0], y=xy[:, 1])

    given = passages.select(*keys, "doc_id", V.doubles(F.col("embedding")).alias("embedding"))
    return given.groupBy(*keys).applyInPandas(run, f"{kinds}, doc_id {passages.schema['doc_id'].dataType.simpleString()}, x double, y double")
