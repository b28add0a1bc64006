"""Context, citations and extractive answers from hits (qid, n, ...), and the window of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: texts of the answers ---
NOTHING = "No encontré normativa en el corpus que responda a esa consulta. Intenta reformularla o quitar los filtros aplicados."
INTRO = "Estos son los fragmentos normativos más relevantes que encontré en el corpus para tu consulta:\n"
NOTE = "\n\n_Modo extractivo (sin modelo de lenguaje): se muestran los fragmentos recuperados con su fuente._"
# --- end of fixed values ---


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _joined(parts: Column, sep: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col("n"), parts.alias("part"))))  # at most the hits of one query
    return F.array_join(F.transform(ordered, lambda x: x["part"]), sep)


def context(hits: DataFrame) -> DataFrame:
    """(qid, contexto): numbered blocks of kind, section, subject and text."""
    head = F.concat(
        F.lit("["), F.col("n").cast("string"), F.lit("] "), F.coalesce("tipo_norma", F.lit("Norma")),
        F.when(_filled("seccion"), F.concat(F.lit(" — "), "seccion")).otherwise(""), F.when(_filled("materia"), F.concat(F.lit(" (materia: "), "materia", F.lit(")"))).otherwise(""),
    )
    return hits.groupBy("qid").agg(_joined(F.concat(head, F.lit("\n"), F.trim(F.coalesce("texto", F.lit("")))), "\n\n---\n\n").alias("contexto"))


def citations(hits: DataFrame, most: int = 600) -> DataFrame:
    """The fields of a citation, with the first ``most`` characters of the text."""
    return hits.select(
        "qid", "n", "titulo", "seccion", "tipo_norma", "materia", "fuente_url", F.substring(F.coalesce("texto", F.lit("")), 1, most).alias("fragmento"), "score",
        F.coalesce("entidades", F.array().cast("array<string>")).alias("entidades"),
    )


def extractive(hits: DataFrame, queries: DataFrame, k: int = 3, most: int = 420) -> DataFrame:
    """(qid, respuesta): the first k hits quoted; a fixed message for queries without hits."""
    label = F.concat(F.coalesce("tipo_norma", F.lit("Norma")), F.when(_filled("seccion"), F.concat(F.lit(" — "), "seccion")).otherwise(""))
    text = F.substring(F.replace(F.trim(F.coalesce("texto", F.lit(""))), F.lit("\n"), F.lit(" ")), 1, most)
    quote = F.concat(F.lit("**["), F.col("n").cast("string"), F.lit("] "), label, F.lit(":** «"), text, F.lit("…»"))
    made = hits.filter(F.col("n") <= k).groupBy("qid").agg(_joined(quote, "\n\n").alias("quotes"))
    answer = F.when(F.col("quotes").isNull(), F.lit(NOTHING)).otherwise(F.concat(F.lit(INTRO + "\n\n"), "quotes", F.lit("\n\n" + NOTE)))
    return queries.select("qid").join(made, "qid", "left").select("qid", answer.alias("respuesta"))


def history_window(turns: DataFrame, k: int = 6) -> DataFrame:
    """The last k turns of each conversation (conv, turno, rol, contenido), roles mapped to two, blank ones dropped after the cut."""
    w = Window.partitionBy("conv").orderBy(F.desc("turno"))
    last = turns.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")
    role = F.when(F.col("rol").isin("assistant", "bot"), F.lit("assistant")).otherwise(F.lit("user"))
    return last.select("conv", "turno", role.alias("rol"), F.trim(F.coalesce("contenido", F.lit(""))).alias("contenido")).filter("contenido <> ''")
