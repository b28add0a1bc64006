"""Keeping an index of pieces: copies, what is still to do, vectors by text, facets and counts."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fojas.plans.lineage import written


def first_of_each(df: DataFrame, key: Column, order: list[Column], salts: int = 32) -> DataFrame:
    """The first row of each key; rows with a null key all stay.

    A first pass within salted keys leaves at most ``salts`` rows of each, so no task holds a frequent key's rows.
    """
    names = df.columns
    keyed = df.withColumn("__key", key).withColumn("__salt", F.pmod(F.hash(*order), F.lit(salts)))
    for keys in (("__key", "__salt"), ("__key",)):
        w = Window.partitionBy(*keys).orderBy(*order)
        keyed = keyed.filter("__key IS NOT NULL").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n").unionByName(keyed.filter("__key IS NULL"))
    return keyed.select(*names)


def unique_documents(docs: DataFrame) -> DataFrame:
    """Downloaded files with the hash of an earlier one are dropped; html pages all stay."""
    page = F.col("formato") == "html"
    return first_of_each(docs, F.when(F.coalesce(page, F.lit(False)), F.lit(None)).otherwise(F.col("hash")), [F.col("doc_id")])


def pending(pieces: DataFrame, indexed: DataFrame, order: list[Column]) -> DataFrame:
    """Pieces whose hash isn't in ``indexed (doc_hash)``, each hash once; pieces without a hash are always pending."""
    done = indexed.select("doc_hash").filter("doc_hash IS NOT NULL").distinct()
    return first_of_each(pieces.join(done, "doc_hash", "left_anti"), F.col("doc_hash"), order)


def vectors_by_text(pieces: DataFrame, objects: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vectors of ``objects (pos, texto, vector)`` for ``pieces`` with the same trimmed text, the lowest pos first; and the pieces without.

    With ``whole`` a piece without a vector is an error.
    """
    known = objects.filter("vector IS NOT NULL").groupBy(F.trim("texto").alias("__t")).agg(F.min_by("vector", "pos").alias("vector"))
    found = pieces.join(known, F.trim(pieces["texto"]) == known["__t"], "left").drop("__t")
    missing = found.filter("vector IS NULL").drop("vector")
    if whole and (n := missing.count()):
        raise ValueError(f"{n} pieces have no vector")
    return found, missing


def systematic_sample(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows at equal steps of the order, from the first on; all rows if there are no more.

    Rows are numbered by a range partitioning and the counts of the partitions before, not by one sort in one task.
    """
    step = -(-rows.count() // max(most, 1))
    if step <= 1:
        return rows
    ordered = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ordered = written(ordered.withColumn("__nth", F.row_number().over(Window.partitionBy("__part").orderBy(*order))), "ordered")
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row a partition
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    numbered = ordered.join(F.broadcast(before), "__part")
    return numbered.filter((F.col("__before") + F.col("__nth") - 1) % step == 0).drop("__part", "__nth", "__n", "__before")


def vector_checks(objects: DataFrame, vector_col: str = "vector") -> DataFrame:
    """One row: number of vectors, shortest and longest, and how many are missing."""
    n = F.size(F.col(vector_col))
    return objects.agg(
        F.count(vector_col).alias("vectores"), F.min(F.when(F.col(vector_col).isNotNull(), n)).alias("dim_min"),
        F.max(F.when(F.col(vector_col).isNotNull(), n)).alias("dim_max"), F.count_if(F.col(vector_col).isNull()).alias("sin_vector"),
    )


def facets(objects: DataFrame, columns: list[str]) -> DataFrame:
    """(faceta, valor, n) of the values that aren't null or empty."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("faceta"), F.col(c).alias("valor")) for c in columns])).alias("x")
    return objects.select(pairs).select("x.*").filter("valor IS NOT NULL AND valor <> ''").groupBy("faceta", "valor").agg(F.count(F.lit(1)).alias("n"))


def compact_corpus(pieces: DataFrame, least: int = 60) -> DataFrame:
    """The eight columns of the portable corpus, trimmed texts of at least ``least`` characters."""
    t = F.trim("texto")
    return pieces.filter(F.length(t) >= least).select(
        "doc_id", F.coalesce("titulo", F.lit("")).alias("titulo"), F.coalesce("seccion", F.lit("")).alias("seccion"), F.coalesce("tipo_norma", F.lit("Norma")).alias("tipo_norma"),
        F.coalesce("materia", F.lit("")).alias("materia"), F.coalesce("fuente_url", F.lit("")).alias("fuente_url"), t.alias("texto"),
        F.coalesce("entidades", F.array().cast("array<string>")).alias("entidades"),
    )


def schema_rows(df: DataFrame) -> DataFrame:
    """(propiedad, tipo, orden) of a table's columns."""
    rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "propiedad string, tipo string, orden int")


def link_closure(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(url, nivel): every page that ``links (desde, hasta)`` reach from ``seeds (url)``, with the fewest steps.

    It ends when a level has no page that wasn't seen before.
    """
    edge = written(seeds.select("url").distinct().withColumn("nivel", F.lit(0)), "edge")
    levels = [edge]
    for level in count(1):
        seen = reduce(DataFrame.unionByName, levels)
        step = links.join(edge.select(F.col("url").alias("desde")), "desde").select(F.col("hasta").alias("url")).distinct()
        edge = written(step.join(seen.select("url"), "url", "left_anti").withColumn("nivel", F.lit(level)), "edge")
        if not edge.limit(1).count():
            return seen
        if len(levels) == 16:  # a plan of bounded size
            levels = [written(seen, "seen")]
        levels.append(edge)
