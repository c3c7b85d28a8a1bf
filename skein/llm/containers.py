"""Problem 9: filling fixed-capacity containers (non-negative least squares over length combinations)."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.store import positioned

#: Containers are cut into windows of the capacity divided by these numbers.
PARTS = (1, 2, 4, 8)
#: Steps of length in a window, and lengths combined in one.
STEPS, DEPTH = 256, 3


@dataclass
class Plan:
    """Where the items go: for each run of positions in the order of falling size, the first window
    or container of the run and how many items in a row share a container's windows."""

    start: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    containers: int = 0

    def put(self, start: int, count: int, base: int, first: int, per: int) -> None:
        if count:
            for row, v in zip((self.start, self.count, self.base, self.first, self.per), (start, count, base, first, per), strict=True):
                row.append(v)


def combinations(sizes: np.ndarray, window: int, step: int) -> np.ndarray:
    """Rows of up to DEPTH bins (indices into ``sizes``, -1 for none) whose upper bounds fill a window:
    their sum is at most the window and less than a step below it."""
    at = {int(s): i for i, s in enumerate(sizes)}
    usable = [int(s) for s in sizes if s <= window and s % step == 0]
    out = []
    for s in usable:
        if window - s < step:
            out.append((at[s], -1, -1))
    for i, a in enumerate(usable):
        for b in usable[: i + 1]:
            rest = window - a - b
            if rest < 0:
                break
            if rest < step:
                out.append((at[a], at[b], -1))
            c = rest - rest % step
            if 0 < c <= b and c in at:
                out.append((at[a], at[b], at[c]))
    return np.array(out, np.int64).reshape(-1, DEPTH)


def repeats(columns: np.ndarray, want: np.ndarray, length: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x with sum over columns near ``want``: accelerated projected gradient.

    The squared error of a bin counts by its length, as long items are the hardest to place later.
    """
    m = len(want)
    if not len(columns):
        return np.zeros(0)
    cols = np.where(columns < 0, m, columns)

    def up(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(cols[:, d], x, m + 1) for d in range(DEPTH))[:m]

    def down(r: np.ndarray) -> np.ndarray:
        r = np.append(r, 0.0)
        return r[cols[:, 0]] + r[cols[:, 1]] + r[cols[:, 2]]

    square = (length / length.mean()) ** 2
    v = np.ones(len(cols))
    for _ in range(30):
        v = down(square * up(v))
        v /= np.linalg.norm(v)
    rate = 1 / max(1e-9, float(np.linalg.norm(down(square * up(v)))) * 1.1)
    x = y = np.zeros(len(cols))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y + rate * down(square * (want - up(y))))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: Mapping[int, int], capacity: int) -> Plan:
    """Plan for items of the given sizes (1 to capacity), from counts alone: its cost grows with the capacity."""
    p = Plan()
    if not histogram:
        return p
    sizes = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(s)] for s in sizes], np.int64)
    total = int(counts.sum())
    # positions run from the largest size down
    begin = total - np.cumsum(counts)
    # bins: the finer, the smaller the items; a bin is a run of sizes named by its upper bound
    windows = [capacity // d for d in PARTS if capacity % d == 0 and capacity // d >= 8]
    step_of = {w: max(1, w // STEPS) for w in windows}
    step = np.array([step_of[min(w for w in windows if w >= s)] for s in sizes])
    upper = -(-sizes // step) * step
    bins = np.unique(upper)
    want = np.zeros(len(bins), np.int64)
    np.add.at(want, np.searchsorted(bins, upper), counts)
    top = np.array([begin[upper == u].min() for u in bins])
    columns, level = [], []
    for w in windows:
        c = combinations(bins, w, step_of[w])
        columns.append(c)
        level.append(np.full(len(c), w))
    cols, level = np.concatenate(columns), np.concatenate(level)
    x = repeats(cols, want.astype(float), bins.astype(float))
    # round; no bin gives more items than it has, so that every planned place is taken
    left = want.copy()
    chosen: list[tuple[int, int]] = []
    for j in np.argsort(-x, kind="stable"):
        n = int(np.rint(x[j]))
        if n <= 0:
            break
        part = cols[j][cols[j] >= 0]
        ids, times = np.unique(part, return_counts=True)
        n = min(n, int((left[ids] // times).min()))
        if n > 0:
            left[ids] -= n * times
            chosen.append((int(j), n))
    used = np.zeros(len(bins), np.int64)
    free: dict[int, list[tuple[int, int]]] = {}  # room: runs of containers (first, number)
    for w in windows:
        per, at = capacity // w, 0
        base = p.containers
        for j, n in chosen:
            if level[j] != w:
                continue
            for b in cols[j][cols[j] >= 0]:
                p.put(int(top[b] + used[b]), n, base, at, per)
                used[b] += n
            at += n
        p.containers += -(-at // per)
        if at % per:
            free.setdefault(capacity - (at % per) * w, []).append((p.containers - 1, 1))
    # the rest goes by falling size into the tightest room that takes it
    rooms = sorted(free)
    for k in range(len(sizes) - 1, -1, -1):
        s, b = int(sizes[k]), int(np.searchsorted(bins, upper[k]))
        a = max(int(begin[k]), int(top[b] + used[b]))
        n = int(begin[k] + counts[k]) - a
        while n > 0:
            i = bisect.bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                first, number = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(i)
            else:
                room, first = capacity, p.containers
                number = max(1, n // (capacity // s))
                p.containers += number
            fits = min(room // s, max(1, n // number))
            take = min(number, n)
            for _ in range(fits):
                p.put(a, take, first, 0, 1)
                a, n = a + take, n - take
            for r, f, c in ((room - fits * s, first, take), (room, first + take, number - take)):
                if c and r > 0:
                    if r not in free:
                        free[r] = []
                        bisect.insort(rooms, r)
                    free[r].append((f, c))
    return p


def pieces(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """Columns ``id_col``, piece, begin, n: an item as it is, or cut at the capacity if it is larger."""
    n = F.col(size_col)
    last = F.greatest(F.ceil(n / capacity).cast("int") - 1, F.lit(0))
    out = sizes.filter(n.isNotNull() & (n >= 0)).select(id_col, n.alias("size"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    begin = F.col("piece").cast("bigint") * capacity
    return out.select(id_col, "piece", begin.alias("begin"), F.least(F.lit(capacity).cast("bigint"), F.col("size") - begin).alias("n"))


def packed(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """Columns ``id_col``, piece, begin, n, container_id.

    Whole items unless larger than ``capacity``; sums of n in a container are at most
    ``capacity``. Items of size 0 take no room and go to container 0; null sizes are left out.
    Items of one size are taken in the order of their ids; a row that is there twice is two items.
    To the driver comes a histogram with at most ``capacity`` counts; items are numbered in the
    order of falling size across all partitions and look up their run of the plan.
    """
    if capacity < 8:
        raise ValueError("capacity must be 8 or more")
    items = pieces(sizes, id_col, size_col, capacity).withColumn("falling", -F.col("n"))
    items, _ = positioned(items.select(F.col(id_col).alias("k"), "piece", "begin", "n", "falling"), ["falling", "k", "piece"], "items")
    histogram = {r["n"]: r["c"] for r in items.filter("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most capacity rows
    p = plan(histogram, capacity)
    order = np.argsort(np.array(p.start, np.int64), kind="stable")
    runs = sizes.sparkSession.sparkContext.broadcast([np.array(v, np.int64)[order] for v in (p.start, p.base, p.first, p.per)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, base, first, per = runs.value
        for batch in batches:
            at = batch.column(4).to_numpy()
            if len(start):
                i = np.maximum(np.searchsorted(start, at, side="right") - 1, 0)
                container = base[i] + (first[i] + at - start[i]) // per[i]
            else:
                container = np.zeros(len(at), np.int64)
            container = np.where(batch.column(3).to_numpy() > 0, container, 0)
            yield pa.record_batch([*batch.columns[:4], pa.array(container, pa.int64())], names=["k", "piece", "begin", "n", "container_id"])

    out = items.select("k", "piece", "begin", "n", "position").mapInArrow(run, "k bigint, piece int, begin bigint, n bigint, container_id bigint")
    return out.withColumnRenamed("k", id_col)
