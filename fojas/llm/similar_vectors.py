"""The k most similar vectors for every vector, by an adaptive dimension scan of inverted lists.

Centroids are fitted on samples; their number grows with the root of the number of vectors, so lists and work stay in
proportion: what the driver can't fit alone is fitted cell by cell in tasks. Every vector is then put into the list of its nearest
centroid and looks for partners in that list and in all those whose centroid is almost as near. Vectors
are turned by one random rotation, so that the first columns of two of them estimate their whole
distance: a candidate is given up as soon as a hypothesis test on that estimate says that it can't
be among the k best, and only the rest are read to the end; of these, only those whose distance in single precision doesn't
rule them out are taken in double precision.

Lists that lie together form blocks of bounded size, a block with its queries is one task, and a list
that alone exceeds the bound is split over several tasks. Equal vectors are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fojas.plans.lineage import broadcast_if_small, written


@dataclass(frozen=True)
class Search:
    """Parameters. The driver fits on ``sample`` vectors (34 MB); it holds and sends one centroid a list: 640 bytes times the root of the number of vectors, 20 MB for 10^9."""

    k: int = 5
    dim: int = 128
    sample: int = 65_536
    lists_per_root: float = 1.25  #: lists = this times the root of the number of vectors,
    rows_per_list: int = 64  #: but no more than one for so many vectors
    rounds: int = 8
    sample_of_list: int = 48  #: vectors that a centroid is fitted on
    near: float = 0.15  #: also probe lists whose squared distance exceeds the nearest one's by this share,
    enough: int = 48  #: and further ones until the lists probed hold this many times k + 1 vectors
    block: int = 16_384  #: most vectors of a block; most queries of a task are twice that
    step: int = 32  #: columns read between two tests
    strict: float = 2.1  #: width of the hypothesis test; larger gives up fewer candidates
    seed: int = 7


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are usable, these as they are, and as vectors of length 1 in double precision."""
    column = column.cast(pa.list_(pa.float32()))
    ok = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dim))
    flat = column.take(pa.array(ok)).flatten().fill_null(math.nan)
    raw = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    v = raw.astype(np.float64)
    size = np.linalg.norm(v, axis=1)
    fine = np.isfinite(size) & (size > 0)
    return ok[fine], raw[fine], v[fine] / size[fine, None]


def _exact(raw: pa.Array, dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _rotation(p: Search) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(p.seed).standard_normal((p.dim, p.dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _centroids(sample: np.ndarray, lists: int, p: Search) -> np.ndarray:
    rng = np.random.default_rng(p.seed)
    c = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(p.rounds):
        at = np.concatenate([np.argmax(sample[i : i + 4096] @ c.T, axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(at, kind="stable")
        some, start = np.unique(at[order], return_index=True)
        new = sample[rng.choice(len(sample), lists)].copy()
        new[some] = np.add.reduceat(sample[order], start, axis=0)
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    return c


def _nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The index of the centroid nearest to each vector."""
    step = max(1, (1 << 23) // len(c))
    return np.concatenate([np.argmax(v[i : i + step] @ c.T, axis=1) for i in range(0, len(v), step)]) if len(v) else np.zeros(0, np.int64)


def _probes(v: np.ndarray, c: np.ndarray, counts: np.ndarray, p: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, rank, list): all lists almost as near as the nearest, and the next ones while those hold too few vectors."""
    dist = 2 - 2 * (v @ c.T)
    keep = dist <= np.maximum(dist.min(axis=1, keepdims=True), 1e-6) * (1 + p.near)
    few = np.flatnonzero(keep @ counts < p.enough * (p.k + 1))
    order = np.argsort(dist[few], axis=1, kind="stable")
    width = 1 + (np.cumsum(counts[order], axis=1) < p.enough * (p.k + 1)).sum(axis=1)
    a, r = np.nonzero(np.arange(len(c)) < width[:, None])
    keep[few[a], order[a, r]] = True
    at, chosen = np.nonzero(keep)
    o = np.lexsort((dist[at, chosen], at))
    at, chosen = at[o], chosen[o]
    return at, np.arange(len(at)) - np.searchsorted(at, at), chosen


def _fitted(rows: DataFrame, n: int, lists: int, turn: np.ndarray, p: Search) -> np.ndarray:
    """About ``lists`` centroids, fitted on vectors drawn by the hash of their id.

    The driver fits as many as its sample is enough for. If more are needed, these are cells, each of which is divided by a fit
    on its own part of a larger sample, in a task, at most ``p.sample`` vectors of a cell.
    """
    def drawn(size: int) -> DataFrame:
        share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(min(1.0, 0.9 * size / max(n, 1)) * (1 << 30)))
        return rows.filter(share).select("id", "vector")

    first = min(lists, p.sample // p.sample_of_list)
    table = drawn(first * p.sample_of_list).limit(p.sample).toArrow().sort_by("id")  # by the ids' hash; the limit is only a guard
    sample = _unit(table.column("vector").combine_chunks(), p.dim)[2].astype(np.float32) if len(table) else np.zeros((0, p.dim), np.float32)
    if not len(sample):
        sample = np.eye(1, p.dim, dtype=np.float32)
    cells = _centroids(sample @ turn, min(first, len(sample)), p)
    if lists <= first:
        return cells

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = (_unit(b.column("vector"), p.dim)[2] @ turn).astype(np.float32)
            yield pa.record_batch({"cell": pa.array(_nearest(v, cells).astype(np.int32)), "unit": pa.array([x.tobytes() for x in v], pa.binary())})

    def divide(t: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(sorted(t.column("unit").to_pylist())), np.float32).reshape(-1, p.dim)
        c = _centroids(v, max(1, min(round(len(v) / p.sample_of_list), len(v))), p)
        return pa.table({"unit": pa.array([x.tobytes() for x in c.astype(np.float32)], pa.binary())})

    most = F.row_number().over(Window.partitionBy("cell", "salt").orderBy("unit")) <= p.sample // 16
    placed = drawn(lists * p.sample_of_list).mapInArrow(place, "cell int, unit binary").withColumn("salt", F.pmod(F.xxhash64("unit"), F.lit(16)))
    fine = placed.withColumn("few", most).filter("few").select("cell", "unit").groupBy("cell").applyInArrow(divide, "unit binary").toArrow()
    return np.frombuffer(b"".join(sorted(fine.column("unit").to_pylist())), np.float32).reshape(-1, p.dim)


def _blocks(c: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """The block of every list: lists are halved along their widest direction until a block holds at most ``most`` rows."""
    block, todo, n = np.zeros(len(c), np.int64), [np.arange(len(c))], 0
    while todo:
        own = todo.pop()
        if rows[own].sum() <= most or len(own) == 1:
            block[own], n = n, n + 1
            continue
        x = c[own] - c[own].mean(axis=0)
        along = own[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        cut = int(np.clip(np.searchsorted(np.cumsum(rows[along]), rows[own].sum() / 2), 1, len(own) - 1))
        todo += [along[:cut], along[cut:]]
    return block


def _scan(q: np.ndarray, known: np.ndarray, base: np.ndarray, q_exact: np.ndarray, exact: np.ndarray, p: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base row, dot) of the pairs that no test gave up and that may be among the k best; ``known``: each query's k-th best dot so far; dots in double precision.

    The k + 1 rows that are nearest in the first columns (one may be the query itself) are read to the
    end at once, so that even the first list has a limit to test against. Where the first test leaves more than one pair in sixteen, all
    pairs are read to the end as one product, which is faster than testing those left one by one, and gives up none of them.
    """
    d, k = p.step, p.k
    part = (q[:, :d] ** 2).sum(1)[:, None] + (base[:, :d] ** 2).sum(1)[None] - 2 * (q[:, :d] @ base[:, :d].T)
    if len(base) > k + 1:
        first = np.argpartition(part, k, axis=1)[:, : k + 1]
        known = np.maximum(known, np.einsum("ij,ikj->ik", q, base[first]).min(axis=1) - 1e-6)
    limit = np.sqrt(np.maximum(2 - 2 * known, 0))
    a, b = np.nonzero(part * (p.dim / d) <= ((1 + p.strict / math.sqrt(d)) * limit[:, None]) ** 2)
    left, many = part[a, b], 16 * len(a) > part.size
    del part
    out, least = [], known - 2e-5  # more than single precision is wrong by
    if many:
        whole = q @ base.T
        stay = whole[a, b] >= least[a]
        a, b, left = a[stay], b[stay], left[stay]
    for i in range(0, len(a), 32_768):  # bounds the memory of the pairs' columns
        u, v, far, d = a[i : i + 32_768], b[i : i + 32_768], left[i : i + 32_768], p.step
        while not many and d + p.step < p.dim and len(u):
            far = far + ((q[u, d : d + p.step] - base[v, d : d + p.step]) ** 2).sum(1)
            d += p.step
            stay = far * (p.dim / d) <= ((1 + p.strict / math.sqrt(d)) * limit[u]) ** 2
            u, v, far = u[stay], v[stay], far[stay]
        if not many:
            stay = 1 - (far + ((q[u, d:] - base[v, d:]) ** 2).sum(1)) / 2 >= least[u]
            u, v = u[stay], v[stay]
        out.append((u, v, np.einsum("ij,ij->i", q_exact[u], exact[v])))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (a, b, np.zeros(0))


def _search(base_id: np.ndarray, base_exact: np.ndarray, base_list: np.ndarray, query_id: np.ndarray, query_exact: np.ndarray, probes: list[np.ndarray], p: Search) -> pd.DataFrame:
    """The best k of the base for each query, from the lists it probes (nearest first), never itself."""
    order = np.lexsort((base_id, base_list))
    base_id, base_exact, base_list = base_id[order], base_exact[order], base_list[order]
    turn = _rotation(p)
    base, query = (base_exact @ turn).astype(np.float32), (query_exact @ turn).astype(np.float32)
    lists, start = np.unique(base_list, return_index=True)
    stop = dict(zip(lists, np.append(start[1:], len(base_list)), strict=True))
    start = dict(zip(lists, start, strict=True))
    k, n = p.k, len(query_id)
    best_id, best = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
    rank = max((len(x) for x in probes), default=0)
    for r in range(rank):
        at = np.array([x[r] if r < len(x) else -1 for x in probes])
        by = np.argsort(at, kind="stable")
        for chosen, own in zip(*_runs(at[by], by), strict=True):
            if chosen not in start:
                continue
            lo, hi = start[chosen], stop[chosen]
            for i in range(0, len(own), 1024):
                some = own[i : i + 1024]
                for j in range(lo, hi, 4096):
                    to = min(j + 4096, hi)
                    a, b, dot = _scan(query[some], np.maximum(best[some, k - 1], -1), base[j:to], query_exact[some], base_exact[j:to], p)
                    keep = query_id[some][a] != base_id[j:to][b]
                    a, b, dot = a[keep], b[keep], np.round(dot[keep], 7)
                    # the k best of each query among the new ones, then against those it has
                    o = np.lexsort((base_id[j:to][b], -dot, a))
                    a, b, dot = a[o], b[o], dot[o]
                    nth = np.arange(len(a)) - np.searchsorted(a, a)
                    few = nth < k
                    new_id, new = np.full((len(some), k), -1, np.int64), np.full((len(some), k), -np.inf)
                    new_id[a[few], nth[few]], new[a[few], nth[few]] = base_id[j:to][b[few]], dot[few]
                    ids, dots = np.hstack((best_id[some], new_id)), np.hstack((best[some], new))
                    o = np.lexsort((ids, -dots), axis=1)[:, :k]
                    best_id[some], best[some] = np.take_along_axis(ids, o, 1), np.take_along_axis(dots, o, 1)
    q, r = np.nonzero(best_id >= 0)
    return pd.DataFrame({"a": query_id[q], "b": best_id[q, r], "cosine": best[q, r]})


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list, list[np.ndarray]]:
    some, start = np.unique(keys, return_index=True)
    return some.tolist(), np.split(values, start[1:])


def similar_vectors(vectors: DataFrame, id_col: str, vector_col: str, p: Search = Search()) -> DataFrame:
    """For every usable vector its k most similar others: (id bigint, neighbour bigint, cosine double).

    ``id_col`` is an integer key. A vector is usable if it has exactly ``p.dim`` finite numbers, not
    all zero; other rows, null ids and null vectors give no rows and are nobody's neighbour. Of
    equal cosines (to 7 digits) the lower id comes first. Of rows under the same id one
    counts, the one with the lowest bytes; with fewer than k others all of them are given (lists that hold too few vectors are
    joined by the next ones). Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(
        F.col("id").isNotNull() & (F.size("vector") == p.dim)
    )
    n = vectors.count()
    lists = int(np.clip(min(p.lists_per_root * math.sqrt(n), n / p.rows_per_list), 1, None))
    turn = _rotation(p)
    centroids = _fitted(rows, n, lists, turn, p)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, raw, v = _unit(b.column("vector"), p.dim)
            home = _nearest((v @ turn).astype(np.float32), centroids).astype(np.int32)
            units = [x.tobytes() for x in v.astype(np.float32)]
            x, y = (pa.array([xxhash.xxh64_intdigest(u, k) - (1 << 63) for u in units], pa.int64()) for k in (1, 2))
            yield pa.record_batch({"id": b.column("id").take(pa.array(at)), "raw": pa.array([r.tobytes() for r in raw], pa.binary()), "home": pa.array(home), "x": x, "y": y})

    placed = written(rows.mapInArrow(assign, "id long, raw binary, home int, x long, y long"), "vectors")
    if placed.count() > placed.select("id").distinct().count():  # repeated ids: the lowest vector stays
        placed = placed.groupBy("id").agg(F.min(F.struct("raw", "home", "x", "y")).alias("s")).select("id", "s.*")
        placed = written(placed, "unique")
    # equal vectors: the lowest id stands for all; the k + 1 lowest ids are all that can be answers
    same = placed.select("id", "x", "y")
    several = same.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1").select("x", "y", "first")
    several = written(several, "equal")
    members = None
    if several.limit(1).count():
        members = written(same.join(broadcast_if_small(several), ["x", "y"]).select("id", "first"), "members")
        later = members.filter("id <> first").select("id")
        placed = placed.join(broadcast_if_small(later), "id", "left_anti")
    counts = np.zeros(len(centroids), np.int64)
    for r in placed.groupBy("home").count().collect():  # a row for each list
        counts[r["home"]] = r["count"]
    block = _blocks(centroids, counts, p.block)
    parts = np.maximum(1, np.ceil(np.bincount(block, counts) / p.block)).astype(int)
    layout = spark.createDataFrame([(i, int(block[i]), int(parts[block[i]])) for i in range(len(block))], "list int, block int, parts int")
    layout = broadcast_if_small(layout)  # a row for each list
    base = (
        placed.join(layout, placed["home"] == layout["list"])
        .select("block", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", "raw", "home", F.lit(None).cast("array<int>").alias("probes"))
    )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 23) // len(centroids))
        for b in batches:
            v = (_exact(b.column("raw"), p.dim) @ turn).astype(np.float32)
            for i in range(0, len(v), step):
                at, nth, chosen = _probes(v[i : i + step], centroids, counts, p)
                yield pa.record_batch({"id": b.column("id").take(pa.array(at + i)), "nth": pa.array(nth.astype(np.int32)), "list": pa.array(chosen.astype(np.int32))})

    asked = (
        placed.select("id", "raw").mapInArrow(choose, "id long, nth int, list int")
        .join(layout, "list")
        .groupBy("id", "block", "parts")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "list"))).alias("probes"))  # at most the lists of a block
        .select("id", "block", "parts", F.col("probes.list").alias("probes"))
    )
    loads = written(asked, "asked")
    per = {r["block"]: r["n"] for r in loads.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each block
    cuts = [int(math.ceil(per.get(b, 1) / (2 * p.block))) for b in range(int(block.max()) + 1)]
    tasks = sum(int(parts[b]) * cut for b, cut in enumerate(cuts))
    before = np.cumsum([0] + [int(parts[b]) * cut for b, cut in enumerate(cuts)])[:-1].tolist()
    slices = broadcast_if_small(spark.createDataFrame([(b, cut, before[b]) for b, cut in enumerate(cuts)], "block int, slices int, before int"))
    group = (F.col("before") + F.col("part") * F.col("slices") + F.col("slice")).alias("group")
    base = base.join(slices, "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(group, "id", "raw", "home", "probes")
    query = (
        loads.join(placed.select("id", "raw"), "id")
        .join(slices, "block")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("slice", F.pmod(F.xxhash64(F.lit(3), "id"), "slices").cast("int"))
        .select(group, "id", "raw", F.lit(None).cast("int").alias("home"), "probes")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one group: a partition has no other rows
        table = pa.Table.from_batches(held) if held else None
        for own in table.column("group").unique().to_pylist() if held else []:
            rows = table.filter(pc.equal(table.column("group"), own))
            ids, home = rows.column("id").to_numpy(), rows.column("home").to_pandas()
            units = _exact(rows.column("raw"), p.dim)
            is_base = home.notna().to_numpy()
            probes = [np.asarray(x) for x in rows.column("probes").filter(pa.array(~is_base)).to_pylist()]
            out = _search(ids[is_base], units[is_base], home[is_base].to_numpy().astype(int), ids[~is_base], units[~is_base], probes, p)
            yield pa.RecordBatch.from_pandas(out, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())]), preserve_index=False)

    # a partition for each group, by its number: a task's input stays bounded however many vectors there are
    found = base.unionByName(query).repartitionById(max(tasks, 1), "group").mapInArrow(search, "a long, b long, cosine double")
    if members is not None:
        found = _with_equals(found, members, p.k)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return found.withColumn("nth", rank).filter(F.col("nth") <= p.k).select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "cosine")


def _with_equals(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Rows for every member of a class of equal vectors: its k lowest classmates, and what its first member found."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    low = salted.withColumn("r", F.row_number().over(Window.partitionBy("first", "salt").orderBy("id"))).filter(F.col("r") <= k + 1)
    low = low.withColumn("r", F.row_number().over(Window.partitionBy("first").orderBy("id"))).filter(F.col("r") <= k + 1).select("first", F.col("id").alias("b"))
    low = written(low, "lowest")
    mates = members.join(broadcast_if_small(low), "first").filter("id <> b").select(F.col("id").alias("a"), "b", F.lit(1.0).alias("cosine"))
    # a neighbour that stands for a class brings that class's lowest members
    wide = found.join(broadcast_if_small(low.withColumnRenamed("b", "other")), found["b"] == F.col("first"), "left")
    wide = wide.select("a", F.coalesce("other", "b").alias("b"), "cosine")
    asked = members.filter("id <> first").select(F.col("first").alias("a"), "id")
    more = wide.join(broadcast_if_small(asked), "a").select(F.col("id").alias("a"), "b", "cosine")
    return wide.unionByName(more).unionByName(mates)


def similar_pairs(vectors: DataFrame, id_col: str, vector_col: str, p: Search = Search()) -> DataFrame:
    """Pairs (low bigint, high bigint) of which at least one is among the other's k most similar; each once."""
    found = similar_vectors(vectors, id_col, vector_col, p)
    return found.select(F.least("id", "neighbour").alias("low"), F.greatest("id", "neighbour").alias("high")).distinct()
