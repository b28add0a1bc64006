"""Measures of retrieval and the silver set of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fojas.functions.text import content_words, title_for_query
from fojas.operators import scan
from fojas.plans.lineage import broadcast_if_small, written


def silver_queries(pieces: DataFrame, n: int, least: int = 200, words: int = 6) -> DataFrame:
    """(query, doc_id_relevante, seccion_origen, chunk_hash) from ``n`` pieces longer than ``least`` characters.

    Pieces and words are drawn by the order of their MD5, so every engine draws the same ones; queries
    with the same text are kept once.
    """
    key = F.md5(F.concat_ws("|", "doc_id", F.col("chunk_index").cast("string")))
    base = pieces.filter(F.length("texto") > least).dropDuplicates(["doc_id", "chunk_index"])
    drawn = base.withColumn("k", key).withColumn("w", F.array_distinct(content_words(F.col("texto")))).filter(F.size("w") > 0).orderBy("k").limit(n)
    by_hash = F.array_sort(F.transform("w", lambda w: F.struct(F.md5(w).alias("h"), w.alias("w"))))
    some = F.array_join(F.transform(F.slice(by_hash, 1, words), lambda x: x["w"]), " ")
    title, part = title_for_query(F.col("titulo")), F.trim(F.coalesce("seccion", F.lit("")))
    query = F.when((part != "") & (title != ""), F.concat(part, F.lit(" de "), title, F.lit(": "), some)).otherwise(F.concat(title, F.lit(": "), some))
    rows = drawn.select(query.alias("query"), F.col("doc_id").alias("doc_id_relevante"), F.col("seccion").alias("seccion_origen"), F.col("doc_hash").alias("chunk_hash"), "k")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("k"))).filter("nth = 1").drop("nth", "k")


def unique_ranking(ranked: DataFrame) -> DataFrame:
    """(qid, doc_id, rank): a ranking of documents without repeats; each keeps its first place, places close up."""
    first = ranked.groupBy("qid", "doc_id").agg(F.min("rank").alias("r"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("r", "doc_id"))).select("qid", "doc_id", "rank")


def relevant_places(scored: DataFrame, documents: DataFrame, relevant: DataFrame) -> DataFrame:
    """(qid, doc_id, rank): the place of every relevant document in the whole ranking of documents by ``scored (qid, pos, score)``.

    ``documents (pos, doc_id)`` names the document of a row; a document stands where its best row does. Places are counted, as
    the documents ahead of the relevant one, so no query's rows are sorted in one task.
    """
    place = F.struct(F.round("score", 9).alias("s"), (-F.col("pos")).alias("p"))
    best = scored.filter("score > 0").join(documents.select("pos", "doc_id"), "pos").groupBy("qid", "doc_id").agg(F.max(place).alias("place"))
    best = written(best, "places")
    wanted = best.join(relevant.select("qid", "doc_id").distinct(), ["qid", "doc_id"]).select("qid", F.col("doc_id").alias("wanted"), F.col("place").alias("own"))
    ahead = best.join(broadcast_if_small(written(wanted, "wanted")), "qid").groupBy("qid", "wanted").agg((F.count_if(F.col("place") > F.col("own")) + 1).alias("rank"))
    return ahead.withColumnRenamed("wanted", "doc_id")


def counted_places(rows: DataFrame, asked: DataFrame, kinds: list[scan.Kind], relevant: DataFrame, mean: float = 1.0) -> DataFrame:
    """(kind, qid, doc_id, rank) as :func:`relevant_places` gives them for each of ``kinds``, without a row for every pair.

    ``rows`` and ``asked`` are those of :mod:`scan`, ``doc`` being the document of a row.
    """
    best = _relevant_rows(rows, asked, kinds, relevant, mean)
    return _ranked(best, scan.placed(rows, asked, best, kinds, mean))


def counted_places_and_best(
    rows: DataFrame, asked: DataFrame, kinds: list[scan.Kind], relevant: DataFrame, top: tuple[int, int], mean: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """:func:`counted_places`, and the best rows of ``scan.best`` for one of the kinds, ``top`` being its index and k, from the same scores."""
    best = _relevant_rows(rows, asked, kinds, relevant, mean)
    found, first = scan.placed_and_best(rows, asked, best, kinds, top, mean)
    return _ranked(best, found), first


def _relevant_rows(rows: DataFrame, asked: DataFrame, kinds: list[scan.Kind], relevant: DataFrame, mean: float) -> DataFrame:
    wanted = relevant.select("qid", "doc_id").distinct()
    lists = wanted.groupBy("qid").agg(F.collect_list("doc_id").alias("wanted"))  # what is relevant for a query
    own = rows.join(wanted.select(F.col("doc_id").alias("doc")).distinct(), "doc", "left_semi")
    return written(scan.best_places(written(own, "relevant"), asked.join(lists, "qid"), kinds, mean), "places")


def _ranked(best: DataFrame, found: DataFrame) -> DataFrame:
    return best.join(found, ["kind", "qid", "pos"]).select("kind", "qid", F.col("doc").alias("doc_id"), "rank")


def metrics(ranked: DataFrame, relevant: DataFrame, k: int, cut_first: bool = False) -> DataFrame:
    """Recall, precision, reciprocal rank and nDCG of every query in ``relevant (qid, doc_id)``: (qid, recall, precision, rr, ndcg).

    ``ranked`` is (qid, doc_id, rank). Repeated documents are dropped before the cut at k, or after it
    with ``cut_first``; the reciprocal rank isn't cut unless ``cut_first``. Queries without any hit have 0.
    """
    if cut_first:
        ranked = ranked.filter(F.col("rank") <= k)
    ranked = unique_ranking(ranked)
    return measures(ranked.join(relevant.select("qid", "doc_id").distinct(), ["qid", "doc_id"]), relevant, k)


def measures(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """The measures of :func:`metrics` from the places of relevant documents, ``hits (qid, doc_id, rank)``."""
    size = relevant.groupBy("qid").agg(F.countDistinct("doc_id").alias("size"))
    near = F.col("rank") <= k
    per = hits.groupBy("qid").agg(
        F.count_if(near).alias("h"), F.min("rank").alias("first"), F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("size"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return size.join(per, "qid", "left").select(
        "qid", (F.coalesce("h", F.lit(0)) / F.col("size")).alias("recall"), (F.coalesce("h", F.lit(0)) / F.lit(k)).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def summary(measured: DataFrame, by: list[str]) -> DataFrame:
    """Means of the measures, rounded to four digits."""
    return measured.groupBy(*by).agg(*[F.round(F.avg(c), 4).alias(c) for c in ("recall", "precision", "rr", "ndcg")], F.count(F.lit(1)).alias("consultas"))


def best_strategy(summed: DataFrame, order: Column) -> DataFrame:
    """The strategy with the highest nDCG; of equal ones the first in ``order``."""
    return summed.orderBy(F.desc("ndcg"), order).limit(1)


def stratified_sample(rows: DataFrame, strata: Column, key: Column, k: int) -> DataFrame:
    """At most k rows of each stratum, by the order of the key's MD5."""
    w = Window.partitionBy("estrato").orderBy(F.md5(key.cast("string")))
    return rows.withColumn("estrato", strata).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).drop("nth")


def tagger_volume(tagged: DataFrame, by: list[str]) -> DataFrame:
    """Rows, rows with an entity, coverage and entities a row."""
    n = F.coalesce(F.size("entidades"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return tagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("filas"), F.count_if(n > 0).alias("con_entidad"), F.round(F.count_if(n > 0) / F.count(F.lit(1)), 4).alias("cobertura"), F.round(F.avg(n), 4).alias("por_fila")
    )


def tagger_recall(tagged: DataFrame, stems: list[tuple[str, str]], label: str) -> DataFrame:
    """By kind of norm: rows whose text has the kind's stem (the ceiling), those of them tagged with it, and the share."""
    spark = tagged.sparkSession
    table = F.broadcast(spark.createDataFrame(stems, "tipo_norma string, raiz string"))  # a few rows
    inside = F.contains(F.lower("texto"), F.col("raiz"))
    hit = F.exists(F.coalesce("entidades", F.array().cast("array<string>")), lambda e: F.lower(e).startswith(label + ":") & F.contains(F.lower(e), F.col("raiz")))
    return tagged.join(table, "tipo_norma").groupBy("tipo_norma").agg(F.count_if(inside).alias("techo"), F.count_if(inside & hit).alias("detectadas")).withColumn(
        "recall", F.round(F.try_divide("detectadas", "techo"), 4)
    )


def form_coverage(tagged: DataFrame, forms: list[tuple[str, str]], taggers: dict[str, Column], stem: int = 7) -> DataFrame:
    """(tagger, etiqueta, forma, n, por_raiz, literal): rows whose ``texto`` has a written form, and those of them tagged with it.

    ``por_raiz`` counts rows with an entity of the form's label that has the first ``stem`` letters of the form's last word, ``literal`` those
    with one that has the whole form. A row with null label and form holds each tagger's totals. Null texts and entities count as empty.
    """
    text, none = F.lower(F.coalesce("texto", F.lit(""))), F.array().cast("array<string>")
    table = F.array(*[F.struct(F.lit(e).alias("etiqueta"), F.lit(f).alias("forma"), F.lit(f.split()[-1][:stem]).alias("raiz")) for e, f in forms])
    tags = F.array(*[F.struct(F.lit(name), F.transform(F.coalesce(c, none), F.lower)).cast("struct<tagger:string,e:array<string>>") for name, c in taggers.items()])
    seen = tagged.select(tags.alias("tags"), F.explode(F.filter(table, lambda f: F.contains(text, f["forma"]))).alias("f")).select("f.*", F.inline("tags"))

    def tagged_with(part: str) -> Column:
        return F.count_if(F.exists("e", lambda x: x.startswith(F.concat("etiqueta", F.lit(":"))) & F.contains(x, F.col(part))))

    found = seen.groupBy("tagger", "etiqueta", "forma").agg(F.count(F.lit(1)).alias("n"), tagged_with("raiz").alias("por_raiz"), tagged_with("forma").alias("literal"))
    empty = F.lit(None).cast("string")
    total = found.groupBy("tagger").agg(*[F.sum(c).alias(c) for c in ("n", "por_raiz", "literal")])
    return found.unionByName(total.withColumn("etiqueta", empty).withColumn("forma", empty))


def unknown_values(values: DataFrame, known: DataFrame, k: int = 8) -> DataFrame:
    """(etiqueta, valor, n): the k most frequent values of each label that neither contain nor are contained in a known one.

    ``known (etiqueta, valor)`` is the closed vocabulary of the rules.
    """
    counted = values.groupBy("etiqueta", "valor").agg(F.count(F.lit(1)).alias("n"))
    rule = known.select(F.col("etiqueta").alias("e"), F.col("valor").alias("v")).distinct()
    near = (counted["etiqueta"] == rule["e"]) & (F.contains(counted["valor"], rule["v"]) | F.contains(rule["v"], counted["valor"]))
    rest = counted.join(rule, near, "left_anti")
    w = Window.partitionBy("etiqueta").orderBy(F.desc("n"), "valor")
    return rest.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).drop("nth")
