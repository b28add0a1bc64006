"""BM25: the index, the scores of a set of queries, the best rows of each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fojas.functions.counts import counted
from fojas.functions.text import STEM, fold, tokens
from fojas.operators import scan
from fojas.plans.lineage import broadcast_if_small, written


@dataclass(frozen=True)
class Index:
    """``postings (pos, term, f, dl)``, ``terms (term, df)`` and the corpus's size: documents and mean length; ``documents (pos, dl, terms, f)`` has
    the postings of a document in one row."""

    postings: DataFrame
    terms: DataFrame
    n: int
    mean_length: float
    documents: DataFrame


def postings(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(pos, term, f, dl): how often each term stands in each document, and the document's length (at least 1).

    A document without a term has one row with a null term and f = 1. Documents are spread by ``pos`` before they are cut up, so
    their terms need no further shuffle, and a table of a few files uses all tasks.
    """
    base = corpus.select(F.col(id_col).alias("pos"), F.col(text_col).alias("text")).repartition("pos").select("pos", tokens(F.col("text")).alias("ts"))
    rows = base.select("pos", F.greatest(F.size("ts"), F.lit(1)).alias("dl"), F.explode_outer("ts").alias("term"))
    return rows.groupBy("pos", "term", "dl").agg(F.count(F.lit(1)).alias("f")).select("pos", "term", "f", "dl")


def corpus_size(corpus: DataFrame, text_col: str) -> DataFrame:
    """One row (n, mean_length) over all documents; length 1 for those without a term."""
    return corpus.select(F.greatest(F.size(tokens(F.col(text_col))), F.lit(1)).alias("dl")).agg(
        F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean_length")
    )


def documents(corpus: DataFrame, id_col: str, text_col: str, dim: int = 0, words: bool = True, keep: dict[str, str] | None = None) -> DataFrame:
    """(pos, dl, terms, f): the postings of each document in one row; arrays are empty for one without a term.

    With ``dim`` also its hashed ``vector`` of so many numbers (null for zeros); without ``words`` that alone. ``keep`` names columns to keep, by
    their new names. A text is read once. Only a table of fewer partitions than cores is spread by ``pos`` first.
    """
    spark, keep = corpus.sparkSession, keep or {}
    base = corpus.select(F.col(id_col).alias("pos"), F.col(text_col).alias("text"), *[F.col(c).alias(k) for k, c in keep.items()])
    if base.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        base = base.repartition("pos")
    kept = ["pos", *keep]
    base = base.select(*kept, fold(F.coalesce("text", F.lit(""))).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({c: b.column(c) for c in kept} | counted(b.column("text"), STEM if words else 0, dim))

    types = [f"{c} {base.schema[c].dataType.simpleString()}" for c in kept] + ["dl int", "terms array<string>", "f array<int>"] * words + ["vector array<double>"] * bool(dim)
    return base.mapInArrow(count, ", ".join(types))


def build_index(corpus: DataFrame, id_col: str, text_col: str, dim: int = 0, keep: dict[str, str] | None = None) -> Index:
    """The index of a corpus, written to the shared folder so that many searches can use it; texts are cut into terms once.

    ``id_col`` is a key. Postings stay spread by document, so no task holds all those of a frequent term. ``dim`` and ``keep`` are those
    of :func:`documents`.
    """
    d = written(documents(corpus, id_col, text_col, dim, keep=keep), "documents")
    size = d.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")).first()
    found = d.select("pos", "dl", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("f").alias("f")))).select("pos", "term", F.col("f").cast("long").alias("f"), "dl")
    terms = written(d.select("terms").mapInArrow(_frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")), "terms")
    return Index(found, terms, size["n"], (size["dl"] or 0) / max(size["n"], 1), d)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.column("terms").flatten().value_counts()
        yield pa.record_batch({"term": n.field("values"), "df": n.field("counts")})


def asked_words(index: Index, queries: DataFrame, query_id: str, query_col: str) -> DataFrame:
    """(qid, words, weights) of the queries that have a term of the corpus: each term once, weighted by its idf times how often the query has it."""
    asked = queries.select(F.col(query_id).alias("qid"), F.explode(tokens(F.col(query_col))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    n, d = F.lit(index.n), F.col("df")
    weight = F.col("times") * F.log(1 + (n - d + 0.5) / (d + 0.5))
    own = asked.join(index.terms, "term").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", weight.alias("weight")))).alias("x"))  # a query's terms
    return written(own.select("qid", F.col("x.term").alias("words"), F.col("x.weight").alias("weights")), "asked")


def best_of(index: Index, queries: DataFrame, query_id: str, query_col: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """The k best rows of each query as :func:`best` of :func:`scores` gives them, (qid, pos, score, nth), without a row for every pair.

    Only the rows of ``allowed (pos)``, if given, can be results.
    """
    rows = index.documents if allowed is None else written(index.documents.join(allowed, "pos", "left_semi"), "allowed")
    return best(scan.best(rows, asked_words(index, queries, query_id, query_col), ["word"], k, index.mean_length), k)


def scores(index: Index, queries: DataFrame, query_id: str, query_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, pos, score) of every document that shares a term with the query; a term counts as often as the query has it.

    Null queries and queries without terms give no rows. Filters don't belong here: size, mean length
    and document frequencies are those of the whole corpus.
    """
    asked = queries.select(F.col(query_id).alias("qid"), F.explode(tokens(F.col(query_col))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    n, d = F.lit(index.n), F.col("df")
    idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
    weight = F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.lit(index.mean_length)))
    terms = written(asked.join(index.terms, "term").select("qid", "term", "times", idf.alias("idf")), "asked")
    found = index.postings.join(broadcast_if_small(terms), "term")
    return found.groupBy("qid", "pos").agg(F.sum(F.col("times") * F.col("idf") * weight).alias("score"))


def best(scored: DataFrame, k: int, corpus: DataFrame | None = None, id_col: str = "pos", where: Column | None = None) -> DataFrame:
    """The k best rows of each query: (qid, pos, score, nth). Scores that aren't positive are dropped; equal ones go by pos.

    ``where`` filters by columns of ``corpus`` after scoring.
    """
    if where is not None:
        allowed = corpus.filter(where).select(F.col(id_col).alias("pos"))
        scored = scored.join(allowed, "pos", "left_semi")
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pos")
    return scored.filter("score > 0").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).select("qid", "pos", "score", "nth")
