"""Exact scores of many queries against all rows, block by block: the best rows, the scores of given ones and what stands ahead of them.

A task holds one block of its rows and the queries and takes the scores of all their pairs, a few queries at a time; only what was asked for
leaves it. So the work grows with rows times queries, but no table does. Best rows and largest scores are looked for among scores in single
precision; what the bound of their error doesn't rule out is then scored in double precision. A score is one of three kinds: ``"word"`` (BM25),
``"cosine"``, or a number alpha: alpha * cosine + (1 - alpha) * word, each over its query's largest one.

``rows`` are (pos, doc) and, as needed, (dl, terms, f) of ``lexical.Index.documents`` and ``vector``; ``asked`` are (qid) and (words, weights),
``vector``, and for alphas ``top_word`` and ``top_cosine``. ``pos`` is a key; equal scores (to nine digits) go by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fojas.plans.lineage import written

Kind = str | float

#: Most rows of a block and queries sent at once (about); fewer rows, but no fewer than LEAST, make up to TASKS blocks of a small table. Pairs scored at once.
ROWS, QUERIES, LEAST, TASKS, PAIRS = 32_768, 65_536, 1_024, 24, 1 << 18
K1, B = 1.2, 0.75
#: A bound of a step's relative error in single precision, and the largest factor that is taken to it.
UNIT, LARGEST = 1.2e-7, 1e30


class _Asked:
    """The queries of a task."""

    def __init__(self, t: pa.Table):
        self.table, self.qid = t, t.column("qid")
        if "words" in t.column_names:
            words = _one(t.column("words"))
            self.vocabulary = words.flatten().unique()
            self.lengths = words.value_lengths().fill_null(0).to_numpy()
            self.codes, self.weights = pc.index_in(words.flatten(), value_set=self.vocabulary).to_numpy(), _one(t.column("weights")).flatten().to_numpy()
            self.begins = np.cumsum(self.lengths) - self.lengths
        if "vector" in t.column_names:
            self.vectors = _matrix(_one(t.column("vector")))
            self.sizes = _sizes(self.vectors)

    def column(self, name: str) -> pa.Array:
        return _one(self.table.column(name))

    def __len__(self) -> int:
        return len(self.table)


class _Block:
    """Rows of a task, by pos, with its queries."""

    def __init__(self, rows: pa.Table, asked: _Asked, mean: float):
        self.asked, self.qid = asked, asked.qid
        rows = rows.take(pc.sort_indices(rows, [("pos", "ascending")])).combine_chunks()
        self.n, self.pos = len(rows), rows.column("pos")
        if "doc" in rows.column_names:
            docs = _one(rows.column("doc")).dictionary_encode(null_encoding="encode")
            self.docs, self.doc = docs.dictionary, docs.indices.to_numpy()
        if "terms" in rows.column_names and "words" in asked.table.column_names:
            self._postings(rows, mean)
        if "vector" in rows.column_names and "vector" in asked.table.column_names:
            self.vectors, self.asked_vectors = _matrix(_one(rows.column("vector"))), asked.vectors
            dim = max(self.vectors.shape[1], self.asked_vectors.shape[1])
            self.vectors, self.asked_vectors = (x if x.shape[1] == dim else np.zeros((len(x), dim)) for x in (self.vectors, self.asked_vectors))
            self.sizes, self.asked_sizes = _sizes(self.vectors), asked.sizes

    def _postings(self, rows: pa.Table, mean: float) -> None:
        terms, known_terms = _one(rows.column("terms")), self.asked.vocabulary
        self.lengths, self.codes, self.weights, self.begins = self.asked.lengths, self.asked.codes, self.asked.weights, self.asked.begins
        at = np.repeat(np.arange(self.n), terms.value_lengths().fill_null(0).to_numpy())
        code = pc.index_in(terms.flatten(), value_set=known_terms)
        known = code.is_valid().to_numpy(zero_copy_only=False)
        code, at, f = code.drop_null().to_numpy(), at[known], _one(rows.column("f")).flatten().to_numpy()[known].astype(float)
        dl = rows.column("dl").to_numpy()[at]
        order = np.argsort(code, kind="stable")
        self.at, self.impact = at[order], (f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean)))[order]
        self.starts = np.searchsorted(code[order], np.arange(len(known_terms) + 1))
        self.keys = code[order].astype(np.int64) * self.n + self.at
        self.wide: dict[int, np.ndarray] = {}  # terms of a quarter of the rows and more

    def _words(self, lo: int, hi: int) -> np.ndarray:
        """Terms are added in the order of the query, so that a pair has the same score in every block."""
        out, part = np.zeros((hi - lo, self.n)), np.empty(self.n)
        for i in range(lo, hi):
            own = out[i - lo]
            for j in range(self.begins[i], self.begins[i] + self.lengths[i]):
                c, w = self.codes[j], self.weights[j]
                a, b = self.starts[c], self.starts[c + 1]
                if b - a > self.n / 4:
                    if c not in self.wide:
                        self.wide[c] = np.zeros(self.n)
                        self.wide[c][self.at[a:b]] = self.impact[a:b]
                    own += np.multiply(self.wide[c], w, out=part)
                else:
                    own[self.at[a:b]] += w * self.impact[a:b]
        return out

    def _cosines(self, lo: int, hi: int) -> np.ndarray:
        out = self.asked_vectors[lo:hi] @ self.vectors.T
        out /= self.asked_sizes[lo:hi, None] * self.sizes[None]
        return out

    def scores(self, kinds: list[Kind]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(index of the kind, index of the first query, scores of some queries with all rows); a kind's part without weight isn't taken."""
        step = max(1, PAIRS // max(self.n, 1))
        with_words, with_cosines = (any(x == own or not isinstance(x, str) and x != none for x in kinds) for own, none in (("word", 1.0), ("cosine", 0.0)))
        fused = any(not isinstance(x, str) for x in kinds)
        for lo in range(0, len(self.asked) if self.n else 0, step):
            hi = min(lo + step, len(self.asked))
            words = self._words(lo, hi) if with_words else None
            cosines = self._cosines(lo, hi) if with_cosines else None
            if fused:
                by_word, by_cosine = (None if x is None else self._over(x, c, slice(lo, hi)) for x, c in ((words, "top_word"), (cosines, "top_cosine")))
            for i, kind in enumerate(kinds):
                if isinstance(kind, str):
                    yield i, lo, words if kind == "word" else cosines
                elif kind in (0.0, 1.0):
                    yield i, lo, by_cosine if kind else by_word
                else:
                    yield i, lo, kind * by_cosine + (1 - kind) * by_word

    def rough(self, kind: Kind) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(index of the first query, scores of some queries with all rows in single precision, by query a bound of their error and what positive scores lie above).

        Where single precision can't hold the numbers the scores are those of :meth:`scores`.
        """
        by_word, by_cosine = self._factors(kind, "word"), self._factors(kind, "cosine")
        sound = by_cosine is None or all(np.isfinite(x).all() for x in (self.vectors, self.sizes, self.asked_vectors, self.asked_sizes))
        if not sound or any(x is not None and x.max(initial=0) > LARGEST for x in (by_word, by_cosine)):
            for _, lo, s in self.scores([kind]):
                yield lo, s, np.zeros(len(s)), np.zeros(len(s))
            return
        signed = False
        if by_cosine is not None:
            base = np.ascontiguousarray((self.vectors / self.sizes[:, None]).T, np.float32)
            asked = (self.asked_vectors * (by_cosine / self.asked_sizes)[:, None]).astype(np.float32)
            signed = base.min(initial=0) < 0 or asked.min(initial=0) < 0  # else rounding leaves positive scores positive
        if by_word is not None:
            impact = self.impact.astype(np.float32)
            starts, codes, begins = self.starts.tolist(), self.codes.tolist(), np.append(self.begins, len(self.codes)).tolist()
            weights = (self.weights * np.repeat(by_word, self.lengths)).astype(np.float32)
            wide = {}  # terms of an eighth of the rows and more
            for c in np.flatnonzero(np.diff(self.starts) > self.n / 8).tolist():
                wide[c] = np.zeros(self.n, np.float32)
                wide[c][self.at[starts[c] : starts[c + 1]]] = impact[starts[c] : starts[c + 1]]
            part = np.empty(self.n, np.float32)
        step = max(1, 2 * PAIRS // max(self.n, 1))
        for lo in range(0, len(self.asked) if self.n else 0, step):
            hi = min(lo + step, len(self.asked))
            error, s = np.zeros(hi - lo), None
            if by_cosine is not None:
                s = asked[lo:hi] @ base
                error = by_cosine[lo:hi] * ((len(base) + 8) * UNIT)
                if kind != "cosine":
                    np.maximum(s, 0, out=s)
            if by_word is not None:
                words = np.zeros((hi - lo, self.n), np.float32)
                for i in range(lo, hi):
                    own = words[i - lo]
                    for j in range(begins[i], begins[i + 1]):
                        c = codes[j]
                        if c in wide:
                            own += np.multiply(wide[c], weights[j], out=part)
                        elif (a := starts[c]) < (b := starts[c + 1]):
                            own[self.at[a:b]] += weights[j] * impact[a:b]
                error = error + words.max(axis=1) * ((self.lengths[lo:hi] + 8) * UNIT)
                s = words if s is None else np.add(s, words, out=s)
            yield lo, s, error, -2 * error if signed else np.zeros(hi - lo)

    def _factors(self, kind: Kind, part: str) -> np.ndarray | None:
        """What the scores of a part are multiplied by for each query; None of a part without weight."""
        if isinstance(kind, str):
            return np.ones(len(self.asked)) if kind == part else None
        weight = kind if part == "cosine" else 1 - kind
        if not weight:
            return None
        top = self.asked.column("top_" + part).fill_null(0.0).to_numpy()
        return weight / np.where(top > 0, top, np.inf)

    def exact(self, kind: Kind, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The scores of these pairs of query and row, as in :meth:`scores`."""
        out = np.zeros(len(q))
        for i in range(0, len(q), PAIRS):
            a, b = q[i : i + PAIRS], r[i : i + PAIRS]
            words = self._own_words(a, b) if kind not in ("cosine", 1.0) else None
            cosines = np.einsum("ij,ij->i", self.asked_vectors[a], self.vectors[b]) / (self.asked_sizes[a] * self.sizes[b]) if kind not in ("word", 0.0) else None
            if not isinstance(kind, str):
                words, cosines = (None if x is None else self._over(x, c, a) for x, c in ((words, "top_word"), (cosines, "top_cosine")))
                if kind not in (0.0, 1.0):
                    words = kind * cosines + (1 - kind) * words
            out[i : i + PAIRS] = cosines if words is None else words
        return out

    def _own_words(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Terms are added in the order of the query here, too."""
        n = self.lengths[q]
        pair = np.repeat(np.arange(len(q)), n)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        j = self.begins[q][pair] + nth
        key = self.codes[j].astype(np.int64) * self.n + r[pair]
        order = np.argsort(key)  # looked up in order, which is faster
        at = np.empty(len(key), np.int64)
        at[order] = np.searchsorted(self.keys, key[order])
        found = np.flatnonzero(np.append(self.keys, -1)[at] == key)
        return np.bincount(pair[found], self.weights[j[found]] * self.impact[at[found]], minlength=len(q))

    def _over(self, s: np.ndarray, column: str, q: slice | np.ndarray) -> np.ndarray:
        top = self.asked.column(column).fill_null(0.0).to_numpy()[q]
        top = top.reshape(-1, *[1] * (s.ndim - 1))
        out = s / np.where(top > 0, top, np.inf)
        return np.fmax(out, 0.0, out=out)


def _one(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def _matrix(v: pa.Array) -> np.ndarray:
    """Null vectors are zeros; the others have one length."""
    there = v.is_valid().to_numpy(zero_copy_only=False)
    out = v.drop_null().flatten().to_numpy().reshape(there.sum(), -1) if there.any() else np.zeros((0, 0))
    if there.all():
        return out
    full = np.zeros((len(v), out.shape[1]))
    full[there] = out
    return full


def _sizes(v: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("ij,ij->i", v, v))
    return np.where(size > 0, size, 1.0)


def _first(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k best positive scores of each query."""
    q, r = _near_first(s, k, np.zeros(len(s)), np.zeros(len(s)), 0.0)
    return _ordered(q, r, s[q, r], k)


def _near_first(s: np.ndarray, k: int, error: np.ndarray, above: np.ndarray, floor: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all that may be among the k best positive scores of each query and not below its ``floor``, if ``s`` is wrong by ``error`` at most
    and only rows ``above`` that can be positive.

    The k-th largest of the maxima of stretches of a query's scores bounds its k-th score from below.
    """
    error, above = error[:, None], above[:, None]
    width = max(1, min(128, s.shape[1] // (8 * k)))
    whole = s.shape[1] // width * width
    most = s[:, :whole].reshape(len(s), -1, width).max(axis=2)
    least = np.partition(most, most.shape[1] - k, axis=1)[:, [most.shape[1] - k]] if most.shape[1] >= k else np.zeros((len(s), 1))
    least = np.maximum(least - 2 * error, floor - error) - 2e-9
    q, r = np.nonzero((most > above) & (most >= least))  # only these stretches have such rows
    q, r = np.repeat(q, width), (r[:, None] * width + np.arange(width)).ravel()
    if whole < s.shape[1]:
        rest = np.arange(whole, s.shape[1])
        q, r = np.append(q, np.repeat(np.arange(len(s)), len(rest))), np.append(r, np.tile(rest, len(s)))
    x = s[q, r]
    keep = (x > above[q, 0]) & (x >= least[q, 0])
    return q[keep], r[keep]


def _ordered(q: np.ndarray, r: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The k best of these pairs with their scores ``x`` for each query, positive ones that aren't below its ``floor``."""
    keep = (x > 0) & (x >= (floor - 2e-9)[q] if isinstance(floor, np.ndarray) else x > 0)
    q, r, x = q[keep], r[keep], x[keep]
    order = np.lexsort((r, -np.round(x, 9), q))
    q, r = q[order], r[order]
    few = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[few], r[few]


def _ahead(s: np.ndarray, own: np.ndarray, before: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """How many documents have a row ahead of each place: a score above ``own``, or an equal one among the first ``before`` rows."""
    if docs < len(s):
        out = np.zeros(len(own), np.int64)
        for j in range(len(own)):
            near = np.flatnonzero((s > 0) & (s > own[j] - 2e-9))
            r = np.round(s[near], 9)
            seen = np.zeros(docs, bool)
            seen[doc[near[(r > own[j]) | ((r == own[j]) & (near < before[j]))]]] = True
            out[j] = seen.sum()
        return out
    near = np.flatnonzero((s > 0) & (s > own.min() - 2e-9))
    r, steps = np.round(s[near], 9), np.unique(own)
    above = np.searchsorted(steps, r)  # so many places have a lower score
    more = np.cumsum(np.bincount(above, minlength=len(steps) + 1)[::-1])[::-1]
    out = more[np.searchsorted(steps, own) + 1]
    tie = np.flatnonzero((above < len(steps)) & (steps[np.minimum(above, len(steps) - 1)] == r))
    for i in range(0, len(tie), 1024):  # bounds the memory of places times ties
        some = tie[i : i + 1024]
        out = out + ((r[some] == own[:, None]) & (near[some] < before[:, None])).sum(axis=1)
    return out


def _run(rows: DataFrame, asked: DataFrame, mean: float, by: str | None, work: Callable[[Iterator[_Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` over the blocks of each task's rows, with up to ``QUERIES`` queries at a time, which are sent to all tasks at once.

    Rows with equal ``by`` share a block, which takes a shuffle; without it rows stay where they are, and a block is a stretch of a task's rows.
    """
    n, nb, nq, sc = rows.count(), _blocks(rows), max(1, math.ceil(asked.count() / QUERIES)), rows.sparkSession.sparkContext
    most = math.ceil(n / nb) if by is None else n
    spread = rows if by is None else rows.repartition(nb, by)

    def found(part: int) -> DataFrame:
        own = asked if nq == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(nq)) == part)
        t = own.toArrow()  # about QUERIES rows
        buffer = pa.BufferOutputStream()
        with pa.ipc.new_stream(buffer, t.schema) as out:
            out.write_table(t)
        sent = sc.broadcast(buffer.getvalue().to_pybytes())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = _stretches(batches, most)
            first = next(parts, None)
            if first is not None:
                queries = _Asked(pa.ipc.open_stream(sent.value).read_all())
                yield from work(_Block(t, queries, mean) for t in chain([first], parts))

        return spread.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [found(i) for i in range(nq)])


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while b.num_rows:
            some = b.slice(0, most - n)
            held, n, b = [*held, some], n + some.num_rows, b.slice(some.num_rows)
            if n == most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _blocks(rows: DataFrame) -> int:
    n = rows.count()
    return max(math.ceil(n / ROWS), min(TASKS, math.ceil(n / LEAST)), 1)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def best(rows: DataFrame, asked: DataFrame, kinds: list[Kind], k: int, mean: float = 1.0) -> DataFrame:
    """(kind int, qid, pos, score): each block's k best positive scores of every query, so that the k best of all are among them.

    Scores below the query's number in the array ``floor`` of ``asked``, by kind, are left out if that column is there.
    """
    def chosen(b: _Block, i: int, pairs: list[tuple[np.ndarray, np.ndarray]], floor: np.ndarray) -> pa.RecordBatch:
        q, r = map(np.concatenate, zip(*pairs, strict=True))
        x = b.exact(kinds[i], q, r)
        at = _ordered(q, np.arange(len(q)), x, k, floor[:, i])[1]  # rows of a query are in their order
        return _batch({"kind": pa.array(np.full(len(at), i, np.int32)), "qid": b.qid.take(pa.array(q[at])), "pos": b.pos.take(pa.array(r[at])), "score": pa.array(x[at])})

    def work(blocks: Iterator[_Block]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            floor = _matrix(b.asked.column("floor")) if "floor" in b.asked.table.column_names and len(b.asked) else np.zeros((len(b.asked), len(kinds)))
            for i, kind in enumerate(kinds):
                pairs = [(np.zeros(0, np.int64),) * 2]
                for lo, s, error, above in b.rough(kind):
                    q, r = _near_first(s, k, error, above, floor[lo : lo + len(s), [i]])
                    pairs.append((q + lo, r))
                    if sum(len(x) for x, _ in pairs) > PAIRS:
                        yield chosen(b, i, pairs, floor)
                        pairs = pairs[:1]
                yield chosen(b, i, pairs, floor)

    return _run(rows, asked, mean, None, work, f"kind int, qid {_type(asked, 'qid')}, pos {_type(rows, 'pos')}, score double")


def largest(rows: DataFrame, asked: DataFrame, kinds: list[Kind], mean: float = 1.0) -> DataFrame:
    """(kind int, qid, score): the largest positive scores of every query in each task; the largest of all is among them."""
    def work(blocks: Iterator[_Block]) -> Iterator[pa.RecordBatch]:
        tops, b = None, None
        for b in blocks:
            tops = np.zeros((len(kinds), len(b.asked))) if tops is None else tops
            for i, kind in enumerate(kinds):
                for lo, s, error, above in b.rough(kind):
                    q, r = _near_first(s, 1, error, above, tops[i, lo : lo + len(s), None])
                    np.maximum.at(tops[i], q + lo, b.exact(kind, q + lo, r))
        if b is not None:
            kind, q = np.nonzero(tops)
            yield _batch({"kind": pa.array(kind.astype(np.int32)), "qid": b.qid.take(pa.array(q)), "score": pa.array(tops[kind, q])})

    return _run(rows, asked, mean, None, work, f"kind int, qid {_type(asked, 'qid')}, score double")


def best_deep(rows: DataFrame, asked: DataFrame, kinds: list[Kind], k: int, mean: float = 1.0) -> DataFrame:
    """:func:`best` for a large k: a first pass with few rows of each block gives a k-th score, below which the second leaves everything out."""
    few = math.ceil(2 * k / _blocks(rows))
    if few > k / 4:
        return best(rows, asked, kinds, k, mean)
    nth = F.row_number().over(Window.partitionBy("qid", "kind").orderBy(F.desc("score")))  # 2 k rows of a query
    limits = best(rows, asked, kinds, few, mean).withColumn("nth", nth).filter(F.col("nth") == k)
    floor = F.array(*[F.coalesce(F.max(F.when(F.col("kind") == i, F.col("score"))), F.lit(0.0)) for i in range(len(kinds))])
    floors = limits.groupBy("qid").agg(floor.alias("floor"))
    return best(rows, written(asked.join(floors, "qid", "left"), "floors"), kinds, k, mean)


def best_places(rows: DataFrame, asked: DataFrame, kinds: list[Kind], mean: float = 1.0) -> DataFrame:
    """(kind int, qid, doc, s, pos): the best row of every document of the array ``wanted`` of a query, its score to nine digits; only positive ones."""
    def of(b: _Block) -> Iterator[pa.RecordBatch]:
        wanted = b.asked.column("wanted")
        begins = np.append(0, np.cumsum(wanted.value_lengths().fill_null(0).to_numpy()))
        code = pc.index_in(wanted.flatten(), value_set=b.docs).fill_null(-1).to_numpy()
        order = np.argsort(b.doc, kind="stable")
        starts = np.searchsorted(b.doc[order], np.arange(len(b.docs) + 1))
        for kind, lo, s in b.scores(kinds):
            out = []
            for i in range(len(s)):
                known = code[begins[lo + i] : begins[lo + i + 1]]
                for c in known[known >= 0].tolist():
                    own = order[starts[c] : starts[c + 1]]
                    r = np.where(s[i, own] > 0, np.round(s[i, own], 9), -1.0)
                    at = int(np.argmax(r))  # the first of equal ones: rows are in the order of pos
                    if r[at] >= 0:
                        out.append((lo + i, c, r[at], own[at]))
            q, c, r, at = (np.array(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
            yield _batch({"kind": pa.array(np.full(len(q), kind, np.int32)), "qid": b.qid.take(pa.array(q)), "doc": b.docs.take(pa.array(c)), "s": pa.array(r.astype(float)), "pos": b.pos.take(pa.array(at))})

    def work(blocks: Iterator[_Block]) -> Iterator[pa.RecordBatch]:
        return chain.from_iterable(map(of, blocks))

    return _run(rows, asked, mean, "doc", work, f"kind int, qid {_type(asked, 'qid')}, doc {_type(rows, 'doc')}, s double, pos {_type(rows, 'pos')}")


def ahead(rows: DataFrame, asked: DataFrame, kinds: list[Kind], mean: float = 1.0, top: tuple[int, int] | None = None) -> DataFrame:
    """(kind int, qid, pos, n, score): for each block and each place of the array ``own (kind, s, pos)`` of a query, how many documents have a row ahead
    of it. With ``top``, a kind's index and k, also each block's k best rows of that kind as :func:`best` gives them, with their score and without n."""
    def of(b: _Block) -> Iterator[pa.RecordBatch]:
        own = b.asked.column("own")
        flat, begins = own.flatten(), np.append(0, np.cumsum(own.value_lengths().fill_null(0).to_numpy()))
        of, score, pos = (flat.field(i).to_numpy() for i in range(3))
        before = np.searchsorted(b.pos.to_numpy(), pos)
        for kind, lo, s in b.scores(kinds):
            at, n = [], []
            for i in range(len(s)):
                j = np.arange(begins[lo + i], begins[lo + i + 1])
                if len(j := j[of[j] == kind]):
                    at.append(j)
                    n.append(_ahead(s[i], score[j], before[j], b.doc, len(b.docs)))
            j = np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)
            q = np.searchsorted(begins, j, side="right") - 1
            yield batch(b, kind, q, pa.array(pos[j]), n=pa.array(np.concatenate([*n, np.zeros(0, np.int64)]).astype(np.int64)))
            if top and kind == top[0]:
                q, r = _first(s, top[1])
                yield batch(b, kind, q + lo, b.pos.take(pa.array(r)), score=pa.array(s[q, r]))

    def batch(b: _Block, kind: int, q: np.ndarray, pos: pa.Array, n: pa.Array | None = None, score: pa.Array | None = None) -> pa.RecordBatch:
        return _batch({
            "kind": pa.array(np.full(len(q), kind, np.int32)), "qid": b.qid.take(pa.array(q)), "pos": pos,
            "n": pa.nulls(len(q), pa.int64()) if n is None else n, "score": pa.nulls(len(q), pa.float64()) if score is None else score,
        })

    def work(blocks: Iterator[_Block]) -> Iterator[pa.RecordBatch]:
        return chain.from_iterable(map(of, blocks))

    return _run(rows, asked, mean, "doc", work, f"kind int, qid {_type(asked, 'qid')}, pos {_type(rows, 'pos')}, n long, score double")


def placed(rows: DataFrame, asked: DataFrame, own: DataFrame, kinds: list[Kind], mean: float = 1.0) -> DataFrame:
    """(kind, qid, pos, rank): the places of the rows ``own (kind, qid, s, pos)`` among all documents by their scores of a kind."""
    return _places(ahead(rows, _with_own(asked, own, "inner"), kinds, mean))


def placed_and_best(rows: DataFrame, asked: DataFrame, own: DataFrame, kinds: list[Kind], top: tuple[int, int], mean: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """:func:`placed`, and :func:`best` for one of the kinds, ``top`` being its index and k, from the same scores."""
    found = written(ahead(rows, _with_own(asked, own, "left"), kinds, mean, top), "ahead")
    return _places(found.filter("n IS NOT NULL")), found.filter("score IS NOT NULL").select("kind", "qid", "pos", "score")


def _with_own(asked: DataFrame, own: DataFrame, how: str) -> DataFrame:
    lists = own.groupBy("qid").agg(F.collect_list(F.struct("kind", "s", "pos")).alias("own"))  # as many as were asked for of a query
    return written(asked.join(lists, "qid", how), "placed")


def _places(found: DataFrame) -> DataFrame:
    return found.groupBy("kind", "qid", "pos").agg((F.sum("n") + 1).alias("rank"))


def _batch(columns: dict[str, pa.Array | pa.ChunkedArray]) -> pa.RecordBatch:
    return pa.record_batch({k: _one(v) if isinstance(v, pa.ChunkedArray) else v for k, v in columns.items()})
