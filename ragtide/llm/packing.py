"""Containers of fixed capacity filled with items of varying length.

The histogram of item lengths is all that a plan sees: at most ``capacity`` rows, however many items there are. Over it a
configuration linear program (one variable for each way to fill a container) is solved by multiplicative weights: a
knapsack dynamic program prices the best configuration at the weights of the moment, and the weight of a length falls as its items are placed.
Each step takes a whole number of containers, no more than the items left allow, so the solution is rounded as it grows and every
container is one of the program's. First-fit decreasing over whole patterns is made beside it and taken where it needs fewer containers.
Each container's plan is a task of its own. Items find their slots by their rank among the items of their length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragtide.sources.tables import durable

#: A plan is broadcast: at most this many (pattern, length) entries, far above what any histogram of a capacity gives.
MOST_ENTRIES = 5_000_000
#: The first weight of a length is its share of the capacity to this power: over 1, so that short items are kept for the gaps.
LEAN = 1.1
#: How far the weight of a length falls (as a power of e) until all its items are placed.
RATE = 0.3
#: Steps that a program is meant to take; each takes this part of the containers if the items allow.
ROUNDS = 200
#: Cells of the knapsack: capacities up to it are priced exactly, larger ones in this many cells, a length taking its cells in full (the room that this leaves is filled up).
GRID = 2048
#: Lengths that are priced at once, those with most items left, and steps between two choices of them.
PRICED, EPOCH = 256, 25
Pattern = list[tuple[int, int]]


class Knapsack:
    """The dearest multiset of sizes that fits a room. Sizes are added one after another, so a size that is dropped costs only those behind it anew."""

    def __init__(self, sizes: np.ndarray, prices: np.ndarray, room: int) -> None:
        self.sizes, self.prices, self.room = sizes, prices, room
        self.live = np.ones(len(sizes), bool)
        self.value = np.zeros((len(sizes) + 1, room + 1))  # by the first j sizes, for every room
        self.stale = 0

    def _add(self, j: int) -> None:
        before, after, size, price = self.value[j], self.value[j + 1], int(self.sizes[j]), self.prices[j]
        if not self.live[j] or size > self.room:
            after[:] = before
        elif 2 * size > self.room:
            after[:size] = before[:size]
            np.maximum(before[size:], before[: self.room + 1 - size] + price, out=after[size:])
        else:  # rooms that differ by whole copies form a column: with k copies more a column's entry is worth k prices more
            rows = -(-(self.room + 1) // size)
            grid = np.full(rows * size, -np.inf)
            grid[: self.room + 1] = before
            grid = grid.reshape(rows, size)
            copies = (np.arange(rows) * price)[:, None]
            after[:] = (np.maximum.accumulate(grid - copies, axis=0) + copies).ravel()[: self.room + 1]

    def best(self) -> tuple[dict[int, int], float]:
        """Copies of each size (by position) and their worth."""
        for j in range(self.stale, len(self.sizes)):
            self._add(j)
        self.stale = len(self.sizes)
        copies: dict[int, int] = {}
        j, c = len(self.sizes), self.room
        while j > 0 and c > 0:
            if self.value[j][c] <= self.value[j - 1][c] + 1e-12:
                j -= 1
            else:
                copies[j - 1] = copies.get(j - 1, 0) + 1
                c -= int(self.sizes[j - 1])
        return copies, float(self.value[-1][self.room])

    def drop(self, j: int) -> None:
        self.live[j] = False
        self.stale = min(self.stale, j)


def _pricing(lengths: np.ndarray, left: np.ndarray, demand: np.ndarray, capacity: int, most: int = PRICED) -> tuple[np.ndarray, Knapsack]:
    """The lengths that are priced (positions, those with most items first; of lengths of as many cells the dearest) and their knapsack."""
    cells = min(capacity, GRID)
    alive = np.flatnonzero(left)
    alive = alive[np.argsort(-left[alive], kind="stable")[:most]]
    prices = (lengths[alive] / capacity) ** LEAN * np.exp(-RATE * (1 - left[alive] / demand[alive]))
    size = -(-lengths[alive] * cells // capacity)
    order = np.lexsort((-prices, size))
    kept = np.sort(order[np.concatenate([[True], np.diff(size[order]) > 0])])
    return alive[kept], Knapsack(size[kept], prices[kept], cells)


def _fill(lengths: np.ndarray, left: np.ndarray, held: dict[int, int], times: int, capacity: int) -> None:
    """Adds to ``held`` the longest lengths that still fit and that all ``times`` containers can have; takes them from ``left``."""
    room = capacity - sum(int(lengths[i]) * a for i, a in held.items())
    while room >= lengths[0]:
        fit = np.flatnonzero(left[: np.searchsorted(lengths, room, side="right")] >= times)
        if not len(fit):
            return
        i = int(fit[-1])
        more = int(min(room // lengths[i], left[i] // times))
        held[i] = held.get(i, 0) + more
        left[i] -= more * times
        room -= more * int(lengths[i])


def program(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[Pattern, int]]:
    """Configurations [(position, copies), ...] and how many containers take each, by multiplicative weights; together they hold every item."""
    left, demand = counts.astype(np.int64).copy(), counts.astype(float)
    share = max(1, int(float((lengths * left).sum()) / capacity / rounds))
    out, sack, age = [], None, 0
    while left.any():
        if sack is None or age >= EPOCH or sack.live.sum() < 0.6 * len(priced):
            priced, sack = _pricing(lengths, left, demand, capacity)
            age = 0
        held = {int(priced[j]): int(min(a, left[priced[j]])) for j, a in sack.best()[0].items()}
        times = max(1, min(share, *(int(left[i] // a) for i, a in held.items())))
        for i, a in held.items():
            left[i] -= a * times
        _fill(lengths, left, held, times, capacity)
        for j in np.flatnonzero(sack.live & (left[priced] == 0)):
            sack.drop(int(j))
        out.append((list(held.items()), times))
        age += 1
    return out


def first_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """First-fit decreasing by whole patterns: a pattern is repeated as long as its items last."""
    left, out = counts.astype(np.int64).copy(), []
    while (alive := np.flatnonzero(left)).size:
        room, pattern = capacity, []
        i = len(alive) - 1
        while i >= 0 and room >= lengths[alive[0]]:
            i = min(i, int(np.searchsorted(lengths[alive], room, side="right")) - 1)
            if i < 0:
                break
            a = int(min(room // lengths[alive[i]], left[alive[i]]))
            pattern.append((int(alive[i]), a))
            room -= a * int(lengths[alive[i]])
            i -= 1
        whole = int(min(left[k] // a for k, a in pattern))
        for k, a in pattern:
            left[k] -= a * whole
        out.append((pattern, whole))
    return out


def bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the best of three solutions of the program's dual.

    Prices by size, one for each item over half the capacity, and the weights the program starts with over the worth of their best configuration (up to GRID, where that is exact).
    """
    if not len(lengths):
        return 0
    best = max(float((lengths * counts).sum()) / capacity, float(counts[2 * lengths > capacity].sum()))
    if capacity <= GRID:
        priced, sack = _pricing(lengths, counts, counts.astype(float), capacity, len(lengths))
        best = max(best, float((sack.prices * counts[priced]).sum()) / sack.best()[1])
    return int(np.ceil(best - 1e-6))


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[Pattern, int]], dict[str, int]]:
    """(patterns [(length, copies), ...] and how many containers take each, together holding every item; figures).

    lengths: distinct, rising, from 1 to ``capacity``; counts: how many items have each. Items that fill a container are a pattern of their own.
    Figures: lp_bound (what any packing needs), program_bins and ffd_bins (either way for all items), by_program (containers of the plan that are the program's, 0 where first-fit needs fewer).
    """
    full, out = 0, []
    if len(lengths) and lengths[-1] == capacity:
        full = int(counts[-1])
        out.append(([(capacity, 1)], full))
        lengths, counts = lengths[:-1], counts[:-1]
    made, plain = program(lengths, counts, capacity, rounds), first_fit(lengths, counts, capacity)
    a, b = (sum(times for _, times in p) for p in (made, plain))
    out += [([(int(lengths[i]), n) for i, n in pattern], times) for pattern, times in (made if a <= b else plain)]
    return out, {"lp_bound": full + bound(lengths, counts, capacity), "program_bins": full + a, "ffd_bins": full + b, "by_program": a if a <= b else 0}


def _slots(patterns: list[tuple[Pattern, int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length the runs of its slots: first rank, first container, copies in a container, place in it."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, times in patterns:
        place = 0
        for length, copies in pattern:
            runs[length].append((ranks[length], base, copies, place))
            ranks[length] += copies * times
            place += copies * length
        base += times
    return runs


#: Distinct containers that one call plans.
MOST_CONTAINERS = 1000


FIGURES = ("lp_bound", "program_bins", "ffd_bins", "by_program")
SLOTS = ("_size", "_first", "_bin", "_copies", "_place")


def _given(containers: DataFrame) -> list[tuple[str | None, int]]:
    given = [(r[0], int(r[1])) for r in containers.select("container", "capacity").where("capacity > 0").dropDuplicates().limit(MOST_CONTAINERS + 1).collect()]
    if len(given) > MOST_CONTAINERS:
        raise ValueError(f"more than {MOST_CONTAINERS} containers")
    return sorted(given, key=lambda x: (x[1], x[0] or ""))


def _parts(sizes: DataFrame, key: str, size: str, given: list[tuple[str | None, int]]) -> tuple[DataFrame, DataFrame]:
    """(the parts of every item for every container, with a chunk; parts by container, size and chunk). Both are read from durable tables."""
    rows = durable(sizes.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_n")))
    options = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(cap).cast("bigint").alias("cap")) for i, (_, cap) in enumerate(given)])
    each = rows.select("*", F.explode(options).alias("_o")).select("_row", "_key", "_n", F.col("_o.c").alias("_c"), F.col("_o.cap").alias("_cap"))
    parts = each.select(
        "_row", "_key", "_c", "_cap",
        F.posexplode(F.expr("transform(sequence(0, greatest(0, cast((_n - 1) div _cap as int))), i -> least(_cap, _n - i * _cap))")).alias("_part", "_size"),
    )
    chunks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.withColumn("_chunk", F.pmod(F.xxhash64("_row", "_part"), F.lit(chunks)).cast("int"))
    # one count serves the histogram and the ranks: at most (containers x capacity x chunks) rows
    return parts, durable(parts.groupBy("_c", "_cap", "_size", "_chunk").agg(F.count("*").alias("_m")))


def _plans(counts: DataFrame, rounds: int) -> DataFrame:
    """For every container the SLOTS of its plan, and one row of size -1 with its FIGURES and, in _bin, its containers; each container is planned in a task of its own."""
    histogram = counts.groupBy("_c", "_cap", "_size").agg(F.sum("_m").alias("_m"))

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        own = f[f["_size"] > 0].sort_values("_size")
        patterns, figures = plan(own["_size"].to_numpy(np.int64), own["_m"].to_numpy(np.int64), int(f["_cap"].iloc[0]), rounds)
        rows = [(size, *run) for size, runs in _slots(patterns).items() for run in runs]
        rows.append((-1, 0, max(1, sum(times for _, times in patterns)), 0, 0))
        out = pd.DataFrame(rows, columns=SLOTS).assign(_c=f["_c"].iloc[0], **dict.fromkeys(FIGURES, 0))
        out.loc[out["_size"] == -1, list(FIGURES)] = [figures[name] for name in FIGURES]
        return out

    names = ", ".join(f"{name} bigint" for name in (*SLOTS, *FIGURES))
    return durable(histogram.groupBy("_c", "_cap").applyInPandas(solve, f"_c int, {names}"))


def pack(sizes: DataFrame, key: str, size: str, containers: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Every item of ``sizes`` in a container, for each row (container, capacity) of ``containers``.

    Returns container, capacity, ``key``, part, part_start, part_size, bin_id (from 0 in each container), bin_start. An item
    of up to ``capacity`` is one part; a larger one is cut into parts of ``capacity`` and a rest. Items of size
    0 (and null sizes, taken as 0) take no room and are dealt over the containers. Repeated rows and null keys
    are items of their own; no row is lost. An empty table, or containers of null or non-positive capacity, give no rows; more than MOST_CONTAINERS distinct containers are an error.
    """
    spark = sizes.sparkSession
    given = _given(containers)
    kind = sizes.schema[key].dataType.simpleString()
    if not given:
        return spark.createDataFrame([], f"container string, capacity bigint, `{key}` {kind}, part bigint, part_start bigint, part_size bigint, bin_id bigint, bin_start bigint")
    parts, counts = _parts(sizes, key, size, given)
    ahead = counts.withColumn("_ahead", F.sum("_m").over(Window.partitionBy("_c", "_size").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).select("_c", "_size", "_chunk", F.coalesce("_ahead", F.lit(0)).alias("_ahead"))
    planned = _plans(counts, rounds)
    if planned.count() > MOST_ENTRIES:
        raise ValueError("the plan is too large to be broadcast")
    slots = planned.select("_c", *SLOTS).toPandas().sort_values(["_c", "_size", "_first"], kind="stable")
    plans = {c: f[list(SLOTS[1:])].to_numpy(np.int64) for c, f in slots.groupby(["_c", "_size"])}
    shared = spark.sparkContext.broadcast(plans)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans = shared.value
        for f in frames:
            bin_id, start = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            ranks = f["_rank"].to_numpy()
            for (c, n), at in f.groupby(["_c", "_size"]).indices.items():
                rank = ranks[at]
                if n == 0:
                    bin_id[at] = rank % plans[c, -1][0, 1]
                    continue
                runs = plans[c, n]
                run = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1]
                k = rank - run[:, 0]
                bin_id[at], start[at] = run[:, 1] + k // run[:, 2], run[:, 3] + k % run[:, 2] * n
            yield f.drop(columns="_rank").assign(_bin=bin_id, _start=start)

    ranked = parts.join(ahead, ["_c", "_size", "_chunk"]).withColumn("_rank", F.row_number().over(Window.partitionBy("_c", "_size", "_chunk").orderBy("_row", "_part")) - 1 + F.col("_ahead"))
    placed = ranked.select("_c", "_cap", "_key", "_part", "_size", "_rank").mapInPandas(place, f"_c int, _cap bigint, _key {kind}, _part int, _size bigint, _bin bigint, _start bigint")
    part = F.col("_part").cast("bigint")
    return placed.select(
        _named(given), F.col("_cap").alias("capacity"), F.col("_key").alias(key), part.alias("part"), (part * F.col("_cap")).alias("part_start"),
        F.col("_size").alias("part_size"), F.col("_bin").alias("bin_id"), F.col("_start").alias("bin_start"),
    )


def _named(given: list[tuple[str | None, int]]) -> Column:
    return F.element_at(F.array(*[F.lit(name).cast("string") for name, _ in given]), F.col("_c") + 1).alias("container")


def plan_summary(sizes: DataFrame, key: str, size: str, containers: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """For each container: capacity, lp_bound, bins, program_bins, ffd_bins, by_program, as ``plan`` has them; no rows for an empty table."""
    given = _given(containers)
    names = ("container", "capacity", "lp_bound", "bins", "program_bins", "ffd_bins", "by_program")
    if not given:
        return sizes.sparkSession.createDataFrame([], ", ".join(f"{n} {'string' if n == 'container' else 'bigint'}" for n in names))
    planned = _plans(_parts(sizes, key, size, given)[1], rounds).where("_size = -1")
    capacity = F.element_at(F.array(*[F.lit(cap).cast("bigint") for _, cap in given]), F.col("_c") + 1).alias("capacity")
    return planned.select(_named(given), capacity, F.col("_bin").alias("bins"), *FIGURES).select(*names)


def pack_summary(packed: DataFrame) -> DataFrame:
    """For each container: bins used, the least that any packing needs, tokens held and the share of room that is used."""
    bins = packed.groupBy("container", "capacity", "bin_id").agg(F.sum("part_size").alias("used"), F.count("*").alias("parts"))
    return bins.groupBy("container", "capacity").agg(
        F.count("*").alias("bins"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("parts").alias("parts"),
        F.ceil(F.sum("used") / F.first("capacity")).alias("least_bins"), (F.sum("used") / (F.count("*") * F.first("capacity"))).alias("filled"),
    )
