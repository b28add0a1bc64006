"""Filling containers of one capacity with texts of varying length.

Only the histogram of lengths, which has at most as many entries as the capacity, comes to the driver.
There, shallow combinations of lengths that fill a window just below the capacity are enumerated, a
non-negative least squares problem gives how often each is repeated so that together they use up the
histogram, the counts are rounded down, and what is left is packed greedily, again as combinations with
repeat counts. The executors then give every text its place from its length and its rank among the
texts of that length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fojas.llm.tokens import RANKS, token_counts
from fojas.plans.lineage import broadcast_if_small, written


@dataclass(frozen=True)
class Pack:
    """Parameters."""

    capacity: int = 2_048
    window: int = 8  #: a combination may leave so many tokens free
    grid: int = 10  #: second and third lengths tried for each first one
    steps: int = 400  #: of the least squares solver
    rank_rows: int = 50_000  #: texts of one length are ranked in groups of about this size


def combinations(sizes: np.ndarray, p: Pack) -> list[tuple[int, ...]]:
    """Up to four lengths, largest first, whose sum lies in the window below the capacity."""
    out: set[tuple[int, ...]] = set()

    def close(room: int) -> np.ndarray:
        hi = np.searchsorted(sizes, room, "right")
        return sizes[max(0, hi - 3) : hi]

    def spread(room: int) -> np.ndarray:
        some = sizes[: np.searchsorted(sizes, room, "right")]
        return some[np.linspace(0, len(some) - 1, min(p.grid, len(some))).astype(int)] if len(some) else some

    def add(*parts: int) -> None:
        if p.capacity - p.window <= sum(parts) <= p.capacity:
            out.add(tuple(sorted(map(int, parts), reverse=True)))

    for a in sizes.tolist():
        room = p.capacity - a
        add(a)
        for b in close(room).tolist():
            add(a, b)
        for b in spread(room).tolist():
            for c in close(room - b).tolist():
                add(a, b, c)
        for b in spread(room // 2).tolist():
            for d in close(room - 2 * b).tolist():
                add(a, b, b, d)
    return sorted(out, reverse=True)


def solve_counts(combos: list[tuple[int, ...]], sizes: np.ndarray, have: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative x with sum of x times combination as close to the histogram as possible (accelerated projected gradient)."""
    at = {s: i for i, s in enumerate(sizes.tolist())}
    col = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    row = np.array([at[s] for c in combos for s in c])
    m, n, h = len(sizes), len(combos), have.astype(float)
    v = np.ones(n)
    for _ in range(30):
        v = np.bincount(col, np.bincount(row, v[col], m)[row], n)
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        g = np.bincount(col, (np.bincount(row, y[col], m) - h)[row], n)
        new = np.maximum(y - g / (1.01 * bound), 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def plan(histogram: dict[int, int], p: Pack) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how many containers take each; together exactly the histogram."""
    have = {s: n for s, n in histogram.items() if 0 < s < p.capacity and n > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    if histogram.get(p.capacity):
        out.append(((p.capacity,), histogram[p.capacity]))
    if have:
        sizes = np.array(sorted(have))
        combos = combinations(sizes, p)
        if combos:
            x = solve_counts(combos, sizes, np.array([have[s] for s in sizes.tolist()]), p.steps)
            for k in np.argsort(-x, kind="stable").tolist():
                if x[k] + 1e-6 < 1:
                    break
                need = Counter(combos[k])
                n = min(int(x[k] + 1e-6), *(have.get(s, 0) // c for s, c in need.items()))
                if n:
                    out.append((combos[k], n))
                    for s, c in need.items():
                        have[s] -= c * n
    # what is left: the largest first, then always the largest that still fits
    left = np.array(sorted(s for s, n in have.items() if n))
    count = np.array([have[s] for s in left.tolist()], np.int64)
    while len(left):
        parts, used, room = [], np.zeros(len(left), np.int64), p.capacity
        k = len(left) - 1
        while k >= 0:
            k = min(k, int(np.searchsorted(left, room, "right")) - 1)
            if k < 0:
                break
            n = min(int(count[k]), room // int(left[k]))
            used[k], room = n, room - n * int(left[k])
            parts += [int(left[k])] * n
            k -= 1
        some = used > 0
        n = int((count[some] // used[some]).min())
        out.append((tuple(parts), n))
        count -= n * used
        left, count = left[count > 0], count[count > 0]
    return out


def _slots(combos: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first container and texts a container, for each combination that takes it."""
    lists: dict[int, list[tuple[int, int, int]]] = {}
    ranks: Counter = Counter()
    first = 0
    for parts, n in combos:
        for s, c in Counter(parts).items():
            lists.setdefault(s, []).append((ranks[s], first, c))
            ranks[s] += c * n
        first += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for s, rows in lists.items()}


def packed(docs: DataFrame, id_col: str, text_col: str, p: Pack = Pack(), path: str = RANKS) -> DataFrame:
    """The container of every text: (id_col, pieza int, desde bigint, tokens bigint, contenedor bigint).

    Containers are numbered from 0 and hold at most ``p.capacity`` tokens. A text has one piece, number
    0, unless it exceeds the capacity: then it is cut into full pieces and a rest, ``desde`` being the
    first token of each. Null and empty texts take no room and lie in container 0. Rows with a null id
    are left out; repeated rows are texts of their own; equal lengths are ranked by a hash of the id, so
    the result doesn't depend on the order of the rows. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    sized = written(token_counts(base, "text", "n", path), "sizes")
    cap = F.lit(p.capacity)
    pieces = F.greatest(F.ceil(F.col("n") / cap), F.lit(1)).cast("int")
    items = sized.select("id", "n", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("pieza"))
    items = items.withColumn("desde", F.col("pieza").cast("long") * cap).withColumn("tokens", F.least(F.col("n") - F.col("desde"), cap)).drop("n")
    full = items.filter("tokens > 0")
    histogram = {r["tokens"]: r["count"] for r in full.groupBy("tokens").count().collect()}  # at most ``capacity`` rows
    spark = docs.sparkSession
    groups = [0] * (p.capacity + 1)
    for s, n in histogram.items():
        groups[s] = -(-n // p.rank_rows)
    group_of = F.pmod(F.xxhash64("id", "pieza"), F.element_at(F.lit(groups[1:] or [1]), F.col("tokens").cast("int"))).cast("int")
    full = full.withColumn("grupo", group_of)
    per = full.groupBy("tokens", "grupo").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("tokens").orderBy("grupo").rowsBetween(Window.unboundedPreceding, -1))
    per = written(per.select("tokens", "grupo", F.coalesce(before, F.lit(0)).alias("vorher")), "groups")
    rank = F.row_number().over(Window.partitionBy("tokens", "grupo").orderBy(F.xxhash64("id", "pieza"), "id", "pieza"))
    ranked = full.withColumn("rank", rank - 1).join(broadcast_if_small(per), ["tokens", "grupo"])
    ranked = ranked.select("id", "pieza", "desde", "tokens", (F.col("rank") + F.col("vorher")).alias("rank"))
    sent = spark.sparkContext.broadcast(_slots(plan(histogram, p)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = sent.value
        for b in batches:
            size, rank = b.column("tokens").to_numpy(), b.column("rank").to_numpy()
            out = np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            some, start = np.unique(size[order], return_index=True)
            for s, own in zip(some.tolist(), np.split(order, start[1:]), strict=True):
                first_rank, first, each = slots[s]
                k = np.searchsorted(first_rank, rank[own], "right") - 1
                out[own] = first[k] + (rank[own] - first_rank[k]) // each[k]
            yield pa.record_batch([*(b.column(c) for c in ("id", "pieza", "desde", "tokens")), pa.array(out)], names=["id", "pieza", "desde", "tokens", "contenedor"])

    schema = f"id {kind}, pieza int, desde long, tokens long, contenedor long"
    found = ranked.mapInArrow(place, schema)
    empty = items.filter("tokens = 0").select("id", "pieza", "desde", "tokens", F.lit(0).cast("long").alias("contenedor"))
    return found.unionByName(empty).withColumnRenamed("id", id_col)


def fill_report(found: DataFrame, p: Pack = Pack()) -> DataFrame:
    """One row: containers, texts' pieces, tokens, capacity and the share of it that is used."""
    used = found.filter("tokens > 0").groupBy("contenedor").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    return used.agg(
        F.count(F.lit(1)).alias("contenedores"), F.coalesce(F.sum("k"), F.lit(0)).alias("piezas"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.lit(p.capacity).cast("long").alias("capacidad"), F.max("t").alias("mas_lleno"), F.round(F.sum("t") / (F.count(F.lit(1)) * p.capacity), 6).alias("ocupado"),
    )
