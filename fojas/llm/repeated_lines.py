"""Lines that return across many documents of one source.

Text is cut into chunks where a rolling hash of the last 16 characters says so, so equal stretches
give equal chunks wherever they stand; a line end is always a cut, too, for the result is lines.
Distinct documents are counted per (chunk, source), and these counts decide: a line that is one chunk
is repeated if its chunk is, and a line of several chunks can only be repeated if all of them are;
what stands in between is settled by counting such lines in full.

A chunk's key holds whether it begins and ends its line, so the chunk of a whole line never stands for a part of a longer one.
Nothing is lost: no chunk of a line is found in fewer documents than the line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fojas.plans.lineage import broadcast_if_small, written

#: Cut where this many bits of the rolling hash are zero: chunks of about 2**CUT_BITS characters.
CUT_BITS = 7
#: Characters that the rolling hash sees.
WINDOW = 16
#: Characters handled at once in a task; bounds the memory of the arrays.
SLICE_CHARS = 1_500_000

_SPACE = np.zeros(0x3002, bool)
_SPACE[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_SPACE[10] = False


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _normal(text: str) -> np.ndarray:
    """Code points in lower case; runs of white space are one space and none at line ends, runs of digits one 0."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_SPACE[np.minimum(c, 0x3001)], np.uint32(32), c)
    c[(c >= 48) & (c <= 57)] = 48
    before = np.concatenate((np.array([10], np.uint32), c[:-1]))
    c = c[~(((c == 32) & ((before == 32) | (before == 10))) | ((c == 48) & (before == 48)))]
    after = np.concatenate((c[1:], np.array([10], np.uint32)))
    return c[~((c == 32) & (after == 10))]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _segment_hash(value: np.ndarray, starts: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of value[starts[k]:starts[k + 1]]; zeros at a segment's end don't count."""
    size = np.diff(np.append(starts, len(value)))
    at = np.arange(len(value)) - np.repeat(starts, size)
    return _mixed(np.add.reduceat(value * _powers(base, int(size.max()))[at], starts))


class _Cut:
    """The lines and chunks of some texts."""

    def __init__(self, texts: list[str]):
        self.lines_of = np.array([t.count("\n") + 1 for t in texts])
        c = _normal("\n".join(texts))
        end = np.flatnonzero(c == 10)
        start, stop = np.append(0, end + 1), np.append(end, len(c))
        full = stop > start
        n = len(c)
        g = c * np.uint32(0x9E3779B1)
        g ^= g >> np.uint32(15)
        g *= np.uint32(0x85EBCA77)
        step = 1
        while step < WINDOW:
            wider = g.copy()
            wider[step:] += g[: n - step] << np.uint32(step)
            g, step = wider, step * 2
        cut = (g >> np.uint32(32 - CUT_BITS)) == 0
        size = stop - start + 1
        inside = np.arange(n) - np.repeat(start, size)[:n]
        cut &= inside >= WINDOW - 1
        first = np.zeros(n + 1, bool)
        first[start[full]] = True
        first[1:][cut] = True
        first = first[:n] & (c != 10)
        value = _mixed(c.astype(np.uint64) + np.uint64(1))
        value[c == 10] = 0
        self.full = np.flatnonzero(full)
        self.chunk_start = np.flatnonzero(first)
        self.value, self.start = value, start[full]
        self.line_of_chunk = np.searchsorted(self.start, self.chunk_start, "right") - 1  # index into full

    def chunks(self) -> np.ndarray:
        """Keys of the chunks: their content, and whether they begin and end their line."""
        if not len(self.chunk_start):
            return np.zeros(0, np.uint64)
        begins = np.append(True, self.line_of_chunk[1:] != self.line_of_chunk[:-1])
        place = begins + 2 * np.append(begins[1:], True)
        return _mixed(_segment_hash(self.value, self.chunk_start, 0x9E3779B97F4A7C15) + place.astype(np.uint64))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.start):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return _segment_hash(self.value, self.start, 0xA0761D6478BD642F), _segment_hash(self.value, self.start, 0xE7037ED1A0B428DB)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    texts = batch.column("text").to_pylist()
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= SLICE_CHARS or i + 1 == len(texts):
            yield at, i + 1, texts[at : i + 1]
            at, held = i + 1, 0


def _with_source(keys: np.ndarray, source: np.ndarray) -> np.ndarray:
    return _mixed(keys ^ _mixed(source)).view(np.int64)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct chunks of every row, with the row's id where several rows have it."""
    for b in batches:
        source = b.column("source").to_numpy().view(np.uint64)
        for lo, hi, texts in _slices(b):
            cut = _Cut(texts)
            doc = np.repeat(np.arange(lo, hi), cut.lines_of)[cut.full][cut.line_of_chunk]
            chunk = _with_source(cut.chunks(), source[doc])
            order = np.lexsort((chunk, doc))
            doc, chunk = doc[order], chunk[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (chunk[1:] != chunk[:-1])
            yield pa.record_batch({"chunk": pa.array(chunk[new]), "again": b.column("again").take(pa.array(doc[new]))})


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        source = b.column("source").to_numpy().view(np.uint64)
        for lo, hi, texts in _slices(b):
            cut = _Cut(texts)
            doc = np.repeat(np.arange(lo, hi), cut.lines_of)
            line = np.arange(len(doc)) - np.repeat(np.cumsum(cut.lines_of) - cut.lines_of, cut.lines_of) + 1
            doc, line = doc[cut.full], line[cut.full]
            one, two = (_with_source(k, source[doc]) for k in cut.keys())
            chunk = _with_source(cut.chunks(), source[doc][cut.line_of_chunk])
            offsets = np.append(np.searchsorted(cut.line_of_chunk, np.arange(len(line))), len(chunk)).astype(np.int32)
            yield pa.record_batch(
                {
                    "id": b.column("id").take(pa.array(doc)),
                    "line_no": pa.array(line.astype(np.int32)),
                    "key_a": pa.array(one),
                    "key_b": pa.array(two),
                    "chunks": pa.ListArray.from_arrays(pa.array(offsets), pa.array(chunk)),
                }
            )


def repeated_chunks(base: DataFrame, min_docs: int) -> DataFrame:
    """(chunk): keys of (chunk, source) found in at least ``min_docs`` distinct documents of ``base (id, source, text)``.

    Rows under an id of their own are counted at once, so partial counts shrink the shuffle; rows that share
    an id, which must count as one document, are told apart by it.
    """
    ids = written(base.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "shared_ids")
    marked = base.join(broadcast_if_small(ids.withColumn("again", F.col("id"))), "id", "left").select("source", "text", "again")
    kind = base.schema["id"].dataType.simpleString()
    rows = marked.mapInArrow(_chunk_rows, f"chunk long, again {kind}")
    per_id = rows.groupBy("chunk", "again").agg(F.count(F.lit(1)).alias("rows"))
    documents = F.sum(F.when(F.col("again").isNull(), F.col("rows")).otherwise(1))
    return per_id.groupBy("chunk").agg(documents.alias("n")).filter(F.col("n") >= min_docs).select("chunk")


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, source: Column, min_docs: int = 10) -> DataFrame:
    """Lines found in at least ``min_docs`` distinct documents of one source: distinct (id_col, line_no int).

    ``source`` is a column expression over ``docs``. Lines are equal when they differ only in letter
    case, white space and digits; ``line_no`` counts from 1 at the splits by ``\\n``.

    Rows with a null id, text or source have no lines; empty lines are never found; a row that is
    repeated counts as one document; an empty table gives an empty result. Other columns of
    ``docs`` are ignored, whatever their names.
    """
    base = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(source).alias("source"), source.isNotNull().alias("known")
    ).filter("known AND id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    often = written(repeated_chunks(base, min_docs), "chunks")
    kind = base.schema["id"].dataType.simpleString()
    lines = base.select("id", "source", "text").mapInArrow(_line_rows, f"id {kind}, line_no int, key_a long, key_b long, chunks array<long>")
    hit = (
        lines.select("id", "line_no", "key_a", "key_b", F.size("chunks").alias("n"), F.explode("chunks").alias("chunk"))
        .join(broadcast_if_small(often), "chunk", "left_semi")
        .groupBy("id", "line_no", "key_a", "key_b", "n")
        .agg(F.count(F.lit(1)).alias("hits"))
        .filter(F.col("hits") >= F.col("n"))
        .select("id", "line_no", "key_a", "key_b", "n")
    )
    hit = written(hit, "lines")
    several = hit.filter("n > 1")
    whole = several.select("id", "key_a", "key_b").distinct().groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
    whole = written(whole.select("key_a", "key_b"), "keys")
    verified = several.join(broadcast_if_small(whole), ["key_a", "key_b"], "left_semi")
    found = hit.filter("n = 1").select("id", "line_no").unionByName(verified.select("id", "line_no"))
    return found.distinct().withColumnRenamed("id", id_col)


def without_repeated_lines(docs: DataFrame, id_col: str, text_col: str, source: Column, min_docs: int = 10) -> DataFrame:
    """``docs`` with the lines of :func:`repeated_lines` cut from ``text_col``; every row and column stays.

    Null texts stay null; a text that loses all its lines becomes empty.
    """
    gone, at = _free(docs, "lines_gone"), _free(docs, "lines_id")
    lines = (
        repeated_lines(docs, id_col, text_col, source, min_docs)
        .groupBy(F.col(id_col).alias(at))
        .agg(F.collect_set("line_no").alias(gone))
    )
    text = F.col(text_col)
    # line numbers of one document: never more than its own lines
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(F.col(gone), i + F.lit(1)))
    new = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n"))
    return docs.join(lines, docs[id_col] == lines[at], "left").withColumn(text_col, new).select(*docs.columns)


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
