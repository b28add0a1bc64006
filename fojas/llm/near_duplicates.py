"""Near-duplicate records by MinHash values that are compared step by step.

Records with the same set of shingles form a class; classes that agree in a band of MinHash values
are candidates. Of a candidate pair the values are compared a few at a time, and the pair is given
up when the posterior probability that its similarity reaches the threshold falls below a tolerance.
What remains is verified on the whole shingle sets.

Text that many records share, like a notice, makes bands that a great part of all classes agree in. If there are too many of them, such a band isn't paired:
its classes are candidates where they share one of their rarest shingles, of which every pair that reaches the threshold
has one in common, however the rest agrees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fojas.plans.lineage import broadcast_if_small, written


@dataclass(frozen=True)
class Near:
    """Parameters. With 40 bands of 4 values a pair of similarity 0.6 is met with probability 0.996, one of 0.8 surely."""

    words: int = 5  #: words of a shingle
    threshold: float = 0.8
    bands: int = 40
    rows: int = 4  #: MinHash values of a band
    step: int = 16  #: values compared between two looks at the posterior
    tolerance: float = 1e-4  #: a pair is given up below this posterior probability
    bucket: int = 256  #: larger buckets are compared in blocks of this many classes,
    large: int = 16_384  #: and the classes of still larger ones are paired by their rarest shingles instead
    seed: int = 11


_WORD = re.compile(r"[^\W_]+")
_KEPT_WORDS = 1_000_000


class _Words(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > _KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _shingles(text: str, n: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words."""
    found = _WORD.findall(text.lower())
    m = len(found) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    x = np.zeros(m, np.uint64)
    for i in range(n):
        x = _mix(x + h[i : i + m])
    return np.unique(x)


def _permutations(p: Near) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    n = p.bands * p.rows
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The last 16 bits of each MinHash value: two different values agree in them once in 65,536 times."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, (x[i : i + 2048, None] * a + b).min(axis=0))
    return low.astype(np.uint16)


def fewest_matches(p: Near) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on), from a uniform prior of the similarity.

    After x matches among m values the posterior is Beta(1 + x, 1 + m - x), so the probability of
    reaching the threshold t is that of at most x successes in m + 1 draws at t.
    """
    out = []
    for m in range(p.step, p.bands * p.rows + 1, p.step):
        total, t = 0.0, p.threshold
        for x in range(m + 1):
            total += comb(m + 1, x) * t**x * (1 - t) ** (m + 1 - x)
            if total >= p.tolerance:
                out.append((m, x))
                break
    return out


def _pruned(one: np.ndarray, two: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Positions of the pairs of MinHash rows that are never given up."""
    alive, matches, before = np.arange(len(one)), np.zeros(len(one), np.int64), 0
    for m, x in needed:
        matches = matches + (one[alive, before:m] == two[alive, before:m]).sum(axis=1)
        alive, matches, before = alive[matches >= x], matches[matches >= x], m
        if not len(alive):
            break
    return alive


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, width)


def near_duplicate_pairs(docs: DataFrame, id_col: str, text_col: str, p: Near = Near()) -> tuple[DataFrame, DataFrame]:
    """Links between classes of records, and the members of every class.

    Returns ``pairs (a, b, similarity double)`` with a < b, ids that stand for their class (the lowest
    id of the records with one set of shingles), and ``members (id, class)`` with every record.
    The similarity is that of the sets of shingles: runs of ``p.words`` words, which are the longest
    runs of letters and digits in lower case.

    Rows with a null id are left out. A null, empty or too short text has no shingles: it is a class
    of its own and has no links. A row repeated under one id counts once; of an id with several texts
    the one with the lowest hash counts. Copies of one text meet in one class and are never paired.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    a, b = _permutations(p)
    width = p.bands * p.rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            ids, x, y, n, values = [], [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                s = _shingles(t or "", p.words, words)
                ids.append(i)
                n.append(len(s))
                raw = s.tobytes()
                x.append(xxhash.xxh64_intdigest(raw, 1) - (1 << 63))
                y.append(xxhash.xxh64_intdigest(raw, 2) - (1 << 63))
                values.append(_minhash(s, a, b).tobytes() if len(s) else None)
            yield pa.record_batch(
                {"id": batch.column("id").take(pa.array(ids, pa.int64())), "x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "n": pa.array(n, pa.int32()), "values": pa.array(values, pa.binary())}
            )

    signed = written(base.mapInArrow(sign, f"id {kind}, x long, y long, n int, values binary"), "signed")
    one = signed.groupBy("id").agg(F.min(F.struct("x", "y", "n")).alias("s")).select("id", "s.*")
    first = one.filter("n > 0").groupBy("x", "y").agg(F.min("id").alias("class"))
    members = one.join(first, ["x", "y"], "left").select("id", F.coalesce("class", "id").alias("class"))
    members = written(members, "members")
    # one row per class; all its records have the same values
    heads = signed.filter("n > 0").groupBy("x", "y").agg(F.first("n").alias("n"), F.first("values").alias("values"))
    heads = heads.join(first, ["x", "y"]).select(F.col("class").alias("id"), "n", "values", "x")
    heads = written(heads, "heads")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("values"), width).reshape(-1, p.bands, p.rows).astype(np.uint64)
            h = np.zeros(v.shape[:2], np.uint64) + np.arange(p.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for i in range(p.rows):
                h = _mix(h + v[:, :, i] + np.uint64(1))
            at = np.repeat(np.arange(len(v)), p.bands)
            yield pa.record_batch({"band": pa.array(_mix(h).ravel().view(np.int64)), "id": batch.column("id").take(pa.array(at)), "n": batch.column("n").take(pa.array(at))})

    keys = heads.drop("x").mapInArrow(bands, f"band long, id {kind}, n int")
    shared = written(keys.groupBy("band").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "bands")
    met = written(keys.join(broadcast_if_small(shared), "band"), "met")
    needed = fewest_matches(p)
    # buckets of bounded size: the pairs, each once however many bands it shares
    few = met.filter(F.col("rows") <= p.bucket).select("band", "id", "n")
    other = few.select("band", F.col("id").alias("b"), F.col("n").alias("m"))
    pairs = (
        few.join(other, "band")
        .filter((F.col("id") < F.col("b")) & (F.least("n", "m") >= p.threshold * F.greatest("n", "m")))
        .select(F.col("id").alias("a"), "b")
        .distinct()
    )
    pairs = written(pairs, "pairs")
    values = heads.select("id", "values")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(_pruned(_matrix(batch.column("one"), width), _matrix(batch.column("two"), width), needed))
            yield pa.record_batch({"a": batch.column("a").take(keep), "b": batch.column("b").take(keep)})

    huge = met.filter(F.col("rows") > p.large).select("id").distinct()
    if huge.limit(1).count():
        by_shingles = _rare_pairs(written(huge, "hot"), heads.select("id", "x"), base, kind, p)
        pairs = written(pairs.unionByName(by_shingles).distinct(), "both")
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
    own = values.join(broadcast_if_small(asked), "id", "left_semi")
    pairs = pairs.join(own.select(F.col("id").alias("a"), F.col("values").alias("one")), "a").join(own.select(F.col("id").alias("b"), F.col("values").alias("two")), "b")
    alive = pairs.mapInArrow(prune, f"a {kind}, b {kind}")
    many = met.filter((F.col("rows") > p.bucket) & (F.col("rows") <= p.large))
    if many.limit(1).count():
        alive = alive.unionByName(_hot_pairs(many, values, kind, width, needed, p)).distinct()
    alive = written(alive, "alive")
    return _verified(alive, heads.select("id", "x"), base, kind, p), members


def _hot_pairs(many: DataFrame, values: DataFrame, kind: str, width: int, needed: list[tuple[int, int]], p: Near) -> DataFrame:
    """Pairs of large buckets that are not given up: a bucket is cut into blocks, a task compares two of them."""
    blocks = F.ceil(F.col("rows") / p.bucket).cast("int")
    placed = many.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "n").join(values, "id")

    def compare(t: pa.Table) -> pa.Table:
        v, n = _matrix(t.column("values"), width), t.column("n").to_numpy()
        own, ids = t.column("own").to_numpy(), np.array(t.column("id").to_pylist())
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        a, b = [], []
        for i in left:
            j = right[(ids[right] > ids[i]) if lo == hi else (ids[right] != ids[i])]
            j = j[np.minimum(n[j], n[i]) >= p.threshold * np.maximum(n[j], n[i])]
            j = j[_pruned(np.broadcast_to(v[i], (len(j), width)), v[j], needed)]
            a += [min(ids[i], x) for x in ids[j]]
            b += [max(ids[i], x) for x in ids[j]]
        value_type = t.schema.field("id").type
        return pa.table({"a": pa.array(a, value_type), "b": pa.array(b, value_type)})

    return placed.groupBy("band", "lo", "hi").applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def _shingle_sets(wanted: DataFrame, base: DataFrame, kind: str, p: Near) -> DataFrame:
    """(id, shingles binary) of the classes in ``wanted (id, x)``: of an id with several texts, the one whose shingles hash to x."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            raw = [_shingles(t or "", p.words, words).tobytes() for t in batch.column("text").to_pylist()]
            own = [xxhash.xxh64_intdigest(r, 1) - (1 << 63) for r in raw]
            keep = pa.array([i for i, x in enumerate(batch.column("x").to_pylist()) if x == own[i]], pa.int64())
            yield pa.record_batch({"id": batch.column("id").take(keep), "shingles": pa.array(raw, pa.binary()).take(keep)})

    texts = base.join(broadcast_if_small(wanted), "id").mapInArrow(sets, f"id {kind}, shingles binary")
    return written(texts.groupBy("id").agg(F.first("shingles").alias("shingles")), "sets")


def _rare_pairs(hot: DataFrame, heads: DataFrame, base: DataFrame, kind: str, p: Near) -> DataFrame:
    """Pairs (a, b) of the classes in ``hot (id)`` that share one of their rarest shingles, and could reach the threshold by their sizes.

    If the shingles of all sets are put in one order, the rarest first, two sets of n and m shingles with similarity t or
    more share at least one of the first n - ceil(t n) + 1 and m - ceil(t m) + 1 of theirs.
    """

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column("shingles").to_pylist()):
                x = np.frombuffer(raw, np.int64)
                ids = batch.column("id").take(pa.array(np.full(len(x), i)))
                yield pa.record_batch({"id": ids, "n": pa.array(np.full(len(x), len(x), np.int32)), "shingle": pa.array(x)})

    sets = _shingle_sets(written(hot.join(heads, "id"), "hot_heads"), base, kind, p)
    rows = sets.mapInArrow(single, f"id {kind}, n int, shingle long")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("docs", "shingle"))  # a group is the shingles of one text
    first = F.col("n") - F.ceil(F.col("n") * F.lit(p.threshold - 1e-9)) + 1
    rare = written(rows.join(often, "shingle").withColumn("place", place).filter((F.col("place") <= first) & (F.col("docs") > 1)).select("shingle", "id", "n"), "rare")
    other = rare.select("shingle", F.col("id").alias("b"), F.col("n").alias("m"))
    fits = (F.col("id") < F.col("b")) & (F.least("n", "m") >= p.threshold * F.greatest("n", "m"))
    return rare.join(other, "shingle").filter(fits).select(F.col("id").alias("a"), "b").distinct()


def _verified(alive: DataFrame, heads: DataFrame, base: DataFrame, kind: str, p: Near) -> DataFrame:
    """The pairs whose whole shingle sets reach the threshold, with the similarity."""

    wanted = alive.select(F.col("a").alias("id")).unionByName(alive.select(F.col("b").alias("id"))).distinct()
    whole = _shingle_sets(written(wanted.join(heads, "id"), "wanted"), base, kind, p)
    pairs = alive.join(whole.select(F.col("id").alias("a"), F.col("shingles").alias("one")), "a").join(
        whole.select(F.col("id").alias("b"), F.col("shingles").alias("two")), "b"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both))
            out = np.array(out, float)
            keep = pa.array(np.flatnonzero(out >= p.threshold - 1e-12))
            yield pa.record_batch({"a": batch.column("a").take(keep), "b": batch.column("b").take(keep), "similarity": pa.array(out).take(keep)})

    return written(pairs.mapInArrow(verify, f"a {kind}, b {kind}, similarity double"), "pairs")


def all_pairs(docs: DataFrame, id_col: str, text_col: str, p: Near = Near()) -> DataFrame:
    """Every pair (a, b) of distinct ids, a < b, whose texts reach the threshold, copies included."""
    pairs, members = near_duplicate_pairs(docs, id_col, text_col, p)
    one, two = members.select(F.col("id").alias("u"), F.col("class").alias("a")), members.select(F.col("id").alias("v"), F.col("class").alias("b"))
    across = pairs.select("a", "b").join(one, "a").join(two, "b").select("u", "v")
    within = one.join(two, F.col("a") == F.col("b")).filter("u < v").select("u", "v")
    pair = F.array_sort(F.array("u", "v"))
    return across.unionByName(within).filter("u <> v").select(pair[0].alias("a"), pair[1].alias("b")).distinct()


def _lowest_reached(edges: DataFrame) -> DataFrame:
    """(id, group): the lowest id that every node of ``edges (a, b)``, which holds both directions, can reach.

    A round gives each node, and the node that it is labelled with, the lowest label next to it; then
    each label takes its own label's label. Hooking labels joins whole trees at once, so the rounds grow with the
    logarithm of a component's length, not with the length. Labels only fall, so the rounds end by themselves,
    and once nothing changes all neighbours agree.
    """
    label = written(edges.select(F.col("a").alias("id")).distinct().withColumn("group", F.col("id")), "labels")
    while True:
        near = edges.join(label, edges["b"] == label["id"]).groupBy(F.col("a").alias("id")).agg(F.min("group").alias("lowest"))
        near = written(label.join(near, "id"), "lowest")
        own = near.select("id", F.least("group", "lowest").alias("group"), F.col("group").alias("before"))
        hooks = near.filter(F.col("lowest") < F.col("group")).groupBy(F.col("group").alias("id")).agg(F.min("lowest").alias("group")).withColumn("before", F.lit(None))
        new = own.unionByName(hooks).groupBy("id").agg(F.min("group").alias("group"), F.max("before").alias("before"))
        new = written(new, "hooked")
        hop = new.select(F.col("id").alias("group"), F.col("group").alias("further"))
        new = written(new.join(hop, "group").select("id", F.least("group", "further").alias("group"), "before"), "labels")
        label = new.select("id", "group")
        if not new.filter(F.col("group") < F.col("before")).limit(1).count():
            return label


def near_duplicate_groups(docs: DataFrame, id_col: str, text_col: str, p: Near = Near()) -> DataFrame:
    """One row per record: (id, class, group, links bigint).

    ``class`` stands for the records with the same shingles, ``group`` (the lowest class that can be
    reached over links) for the connected records, ``links`` counts the class's links to others.
    """
    pairs, members = near_duplicate_pairs(docs, id_col, text_col, p)
    edges = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = _lowest_reached(edges)
    links = edges.groupBy(F.col("a").alias("class")).agg(F.count(F.lit(1)).alias("links"))
    return (
        members.join(links, "class", "left")
        .join(label.select(F.col("id").alias("class"), "group"), "class", "left")
        .select("id", "class", F.coalesce("group", "class").alias("group"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    )
