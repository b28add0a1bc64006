"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fojas.functions.urls import site_of


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines found in at least ten records of one site."""
    from fojas.llm.repeated_lines import repeated_lines

    return repeated_lines(_table(spark, sf, "extracted"), "doc_id", "texto", site_of(F.col("fuente_url")))


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every record's text without those lines."""
    from fojas.llm.repeated_lines import without_repeated_lines

    docs = _table(spark, sf, "extracted").select("doc_id", "fuente_url", "texto")
    return without_repeated_lines(docs, "doc_id", "texto", site_of(F.col("fuente_url"))).distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of objects of which one is among the other's five most similar."""
    from fojas.llm.similar_vectors import similar_pairs

    return similar_pairs(_table(spark, sf, "normativa"), "pos", "vector").toDF("pos_a", "pos_b")


def p2_similar(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar others of every object."""
    from fojas.llm.similar_vectors import similar_vectors

    found = similar_vectors(_table(spark, sf, "normativa"), "pos", "vector")
    return found.select("id", "neighbour", F.round("cosine", 4).alias("cosine"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values of texto and titulo with a stretch that a wrong decoding has garbled."""
    from fojas.llm.garbled_text import garbled_values

    return garbled_values(_table(spark, sf, "extracted"), "doc_id", ["texto", "titulo"]).select("doc_id", "campo").distinct()


def p3_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Those values with the original wording wherever it can be recovered."""
    from fojas.llm.garbled_text import garbled_values

    return garbled_values(_table(spark, sf, "extracted"), "doc_id", ["texto", "titulo"])


def _html(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "extracted").select("doc_id", "titulo", "fuente_url", "formato", "texto").filter("formato = 'html'")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of html records that don't belong to the norm itself."""
    from fojas.llm.main_content import page_furniture

    return page_furniture(_html(spark, sf), "doc_id", "texto", site_of(F.col("fuente_url")), F.col("titulo"), F.col("fuente_url"))


def p4_body(spark: SparkSession, sf: str) -> DataFrame:
    """Every html record with the norm alone."""
    from fojas.llm.main_content import main_content

    return main_content(_html(spark, sf), "doc_id", "texto", site_of(F.col("fuente_url")), F.col("titulo"), F.col("fuente_url")).distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of records whose runs of three words agree to 0.6 or more."""
    from fojas.llm.near_duplicates import Near, all_pairs

    return all_pairs(_table(spark, sf, "extracted"), "doc_id", "texto", Near(words=3, threshold=0.6)).toDF("doc_id_a", "doc_id_b")


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Class, group and number of links of every record, on runs of five words and a similarity of 0.8."""
    from fojas.llm.near_duplicates import near_duplicate_groups

    found = near_duplicate_groups(_table(spark, sf, "extracted"), "doc_id", "texto")
    return found.select(F.col("id").alias("doc_id"), F.col("class").alias("clase"), F.col("group").alias("grupo"), F.col("links").alias("enlaces"))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every text."""
    from fojas.llm.packing import packed

    return packed(_table(spark, sf, "documents"), "doc_id", "text")


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are."""
    from fojas.llm.packing import fill_report, packed

    return fill_report(packed(_table(spark, sf, "documents"), "doc_id", "text"))


def _goals(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "mezcla_objetivo").select("source", F.col("peso_objetivo").alias("share"), F.col("max_repeticiones").alias("cap"))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from fojas.llm.mixing import mixed

    goals = _goals(spark, sf)
    return mixed(_table(spark, sf, "documents"), "doc_id", "text", "source", F.lower(F.trim("lang")), F.lower(F.trim("materia")), goals)


def p7_uses(spark: SparkSession, sf: str) -> DataFrame:
    """How often every text is used."""
    return _mixed(spark, sf)[0].select("id", "source", "tokens", "uses").toDF("doc_id", "source", "tokens", "usos")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of the tokens that every source reaches."""
    found = _mixed(spark, sf)[1].toDF("source", "peso_objetivo", "peso_posible", "max_repeticiones", "limita", "textos", "tokens", "usados", "peso_alcanzado")
    return found.withColumns({c: F.round(c, 6) for c in ("peso_posible", "peso_alcanzado")})


def p7_margins(spark: SparkSession, sf: str) -> DataFrame:
    """The shares of languages and topics, in the sources' texts and in what is used."""
    from fojas.llm.mixing import margins

    found = margins(_mixed(spark, sf)[0], _goals(spark, sf)).toDF("lado", "valor", "peso_objetivo", "peso_alcanzado")
    return found.withColumns({c: F.round(c, 6) for c in ("peso_objetivo", "peso_alcanzado")})


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence units of every document."""
    from fojas.llm.sentences import sentences

    return sentences(_table(spark, sf, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_clean": p1_clean, "p2_found": p2_found, "p2_similar": p2_similar, "p3_found": p3_found, "p3_restored": p3_restored, "p4_found": p4_found, "p4_body": p4_body, "p5_found": p5_found, "p5_groups": p5_groups, "p6_containers": p6_containers, "p6_fill": p6_fill, "p7_uses": p7_uses, "p7_shares": p7_shares, "p7_margins": p7_margins, "p8_found": p8_found}


_SITE = r"nullif(regexp_extract(lower(trim(fuente_url)), '^(?:[a-z][a-z0-9+.\-]*://|//)?(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)', 1), '')"
_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_P1_LINES = rf"""
WITH recs AS (SELECT DISTINCT doc_id, texto, {_SITE} AS site FROM extracted WHERE texto IS NOT NULL),
lines AS (SELECT doc_id, site, unnest(string_split(texto, chr(10))) AS line, generate_subscripts(string_split(texto, chr(10)), 1) AS line_no FROM recs),
keyed AS (SELECT doc_id, site, line_no, regexp_replace(trim(regexp_replace(lower(line), '{_SPACES}', ' ', 'g')), '[0-9]+', '0', 'g') AS k FROM lines),
often AS (SELECT site, k FROM keyed WHERE site IS NOT NULL AND k <> '' GROUP BY site, k HAVING count(DISTINCT doc_id) >= 10)
"""

P1_FOUND = _P1_LINES + "SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN often USING (site, k)"

P1_CLEAN = (
    _P1_LINES
    + """, gone AS (SELECT DISTINCT doc_id, line_no FROM keyed JOIN often USING (site, k)),
kept AS (SELECT l.doc_id, l.line_no, any_value(l.line) AS line FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY ALL),
whole AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM kept GROUP BY doc_id)
SELECT DISTINCT e.doc_id, e.fuente_url, CASE WHEN e.texto IS NULL THEN NULL ELSE coalesce(w.t, '') END AS texto
FROM extracted e LEFT JOIN whole w USING (doc_id)"""
)


P5_FOUND = r"""
WITH t AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(texto), '[\p{L}\p{N}]+') AS w FROM extracted WHERE texto IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT p AS doc_id_a, q AS doc_id_b FROM b JOIN n u ON u.doc_id = p JOIN n v ON v.doc_id = q WHERE k >= 0.6 * (u.n + v.n - k)"""

P2_FOUND = """
WITH u AS (SELECT pos, list_transform(vector, lambda x: x::DOUBLE) AS v FROM normativa WHERE len(vector) = 128 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
n AS (SELECT pos, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u),
s AS (SELECT a.pos AS p, b.pos AS q, row_number() OVER (PARTITION BY a.pos ORDER BY round(list_dot_product(a.v, b.v), 7) DESC, b.pos) AS r FROM n a JOIN n b ON a.pos <> b.pos)
SELECT DISTINCT least(p, q) AS pos_a, greatest(p, q) AS pos_b FROM s WHERE r <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_clean": P1_CLEAN, "p2_found": P2_FOUND, "p5_found": P5_FOUND}
