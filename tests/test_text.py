from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fojas.functions import entities, text, urls
from fojas.functions.vectors import hash_encode, l2_normalize


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="Résolución N° 15, año a") == ["resoluc", "15", "ano"]
    assert one(spark, text.tokens(F.col("t")), t="operadores operador") == ["operado", "operado"]
    assert one(spark, text.tokens(F.col("t")), t=None) == []


def test_lines_and_dates(spark):
    assert one(spark, text.normalize_lines(F.col("t")), t=" a  b \n\n\t\nc ") == "a b\nc"
    assert str(one(spark, text.first_date(F.col("t")), t="el 3/4/2020 y 5/5/2021")) == "2020-04-03 00:00:00"
    assert one(spark, text.first_date(F.col("t")), t="el 31/2/2020 y 5/5/2021") is None
    assert one(spark, text.first_date(F.col("t")), t=None) is None


def test_kind_and_subject(spark):
    assert one(spark, text.infer_kind(F.col("u"), F.col("t")), u="http://x/decreto-resolucion", t=None) == "Resolución"
    assert one(spark, text.infer_kind(F.col("u"), F.col("t")), u=None, t=None) == "Documento normativo"
    assert one(spark, text.infer_subject(F.col("u"), F.col("t")), u="", t="Encaje y precios") == "Precios e inflación"
    assert one(spark, text.infer_subject(F.col("u"), F.col("t")), u="", t="Título") == "General"


def test_urls(spark):
    for u, site in (("https://www.A.example:8080/x", "a.example"), ("http://u:p@b.example", "b.example"), ("c.example/x", "c.example"), ("", None), (None, None)):
        assert one(spark, urls.site_of(F.col("u")), u=u) == site
    assert one(spark, urls.slug(F.col("u")), u="https://h/a/b c.pdf?x=1") == "a_b_c.pdf"
    assert one(spark, urls.slug(F.col("u")), u="https://h/") == "index"


def test_entities_against_python(spark):
    t = "El Ministerio y la RESOLUCIÓN de enero de 2020; resoluciones, Bs. 100, óbono, bono."
    found = []
    for label, p in entities.RULES:
        found += [f"{label}:{m[0].strip().lower()}" for m in re.finditer(rf"(?<![\w])(?:{p})(?!\w)", t, re.I)]
    assert one(spark, entities.rule_entities(F.col("t")), t=t) == list(dict.fromkeys(found))
    assert one(spark, entities.rule_entities(F.col("t")), t=None) == []


def test_canonical_and_ensemble(spark):
    df = spark.createDataFrame([(["a:x\n y", "a:x y", "b:", "moneda:tipo de cambio", "a: z ", "c"], ["periodo:mes", "a:new"])], "e array<string>, m array<string>")
    got = df.select(entities.canonical(F.col("e")).alias("c"), entities.ensemble(F.col("e"), F.col("m")).alias("n"), entities.canonical(F.lit(None).cast("array<string>")).alias("z")).first()
    assert got["c"] == ["a:x y", "a:z"] and got["n"] == ["a:x y", "a:z", "a:new"] and got["z"] == []


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], "hola hola ab mundo"), ([0.0, 0.0], None)], "v array<float>, t string")
    rows = df.select(l2_normalize(F.col("v")).alias("v"), hash_encode(F.col("t"), 8).alias("h")).collect()
    assert [round(x, 6) for x in rows[0]["v"]] == [0.6, 0.8] and rows[1]["v"] == [0.0, 0.0]
    assert sum(rows[0]["h"]) == 3 and max(rows[0]["h"]) >= 2 and sum(rows[1]["h"]) == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=6000), st.integers(5, 60))
def test_size_spans_cover(t, most):
    from fojas.operators.chunking import Sizes, size_spans

    s = Sizes(most=most, overlap=most // 4)
    spans = list(size_spans(t, s))
    assert all(0 < b - a <= most for a, b in spans)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered for i, c in enumerate(t) if not c.isspace())
