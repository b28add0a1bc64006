from __future__ import annotations

import pytest

from fojas.llm import garbled_text as g
from fojas.llm.garbled_text import garbled_values

GOOD = "La Resolución N° 15 rige según el régimen único; está vigente la decisión del comité técnico"
FRIENDS = ["Gutachten der Börsenaufsicht: größere Beträge", "Monto en € y en ¥: 3ª y 4º tramo, § 8", "El símbolo Ã junto a ±, ¢ y £", "¿Qué? ¡Sí!"]
WAYS = {
    "utf8": lambda t: t.encode().decode("latin-1"), "twice": lambda t: t.encode().decode("cp1252").encode().decode("cp1252"),
    "mac": lambda t: t.encode().decode("mac_roman"), "cyrillic": lambda t: t.encode().decode("cp1251"),
    "dos": lambda t: t.encode("cp850").decode("cp1252"), "windows": lambda t: t.encode("cp1252").decode("cp850"),
    "lost": lambda t: "".join(c if c.isascii() else "�" for c in t),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"g{i}", GOOD, None if i % 2 else GOOD) for i in range(60)] + [(f"f{i}", t + " " + GOOD, "") for i, t in enumerate(FRIENDS)]
    rows += [(k, "Sin daño. " + way(GOOD), "título") for k, way in WAYS.items()] + [("utf8", "Sin daño. " + WAYS["utf8"](GOOD), "título"), (None, WAYS["mac"](GOOD), None), ("null", None, None)]
    df = spark.createDataFrame(rows, "id string, campo string, x string").withColumnRenamed("campo", "texto").selectExpr("*", "1 AS campo", "'k' AS restaurado")
    return garbled_values(df, "id", ["texto", "x"]).collect()


def test_only_damage_is_found(found):
    assert sorted((r["id"], r["campo"]) for r in found) == sorted((k, "texto") for k in WAYS)


@pytest.mark.parametrize("name", list(WAYS))
def test_original_comes_back(found, name):
    assert {r["id"]: r["restaurado"] for r in found}[name] == "Sin daño. " + GOOD


def test_empty(spark):
    assert garbled_values(spark.createDataFrame([], "id string, t string"), "id", ["t"]).count() == 0


def test_damage_that_looks_like_sound_signs(spark):
    good = "Podrá dictar órdenes si podrá el comité según el ARTÍCULO y los Términos del índice y ellos incumplió"
    sound = ["—Sí, dijo el «Banco» y “otros” —el resto— ‘así’ · fin…", "¿Qué es? ¿Quién podrá? véase page?id=3", "El\u00a0Banco y 5\u00a0%\u00a0"]
    bad = ["Se podr\u00a0 vender", "Se podr· vender", "Las —rdenes", "Se incumpli— ayer", "El ’ndice", "El comitÚ", "Los TÚrminos", "El ART?CULO", "Las ?rdenes"]
    want = ["Se podrá vender", "Se podrá vender", "Las órdenes", "Se incumplió ayer", "El índice", "El comité", "Los Términos", "El ARTÍCULO", "Las órdenes"]
    rows = [(f"g{i}", good) for i in range(60)] + [(f"s{i}", t) for i, t in enumerate(sound)] + [(f"b{i}", t) for i, t in enumerate(bad)]
    got = {r["id"]: r["restaurado"] for r in garbled_values(spark.createDataFrame(rows, "id string, t string"), "id", ["t"]).collect()}
    assert got == {f"b{i}": t for i, t in enumerate(want)}


def test_capitals_stay_though_damage_is_frequent(spark):
    good, bad = "El banco procederá y tendrá los años", "EL BANCO PROCEDER¡ Y TENDR¡ LOS A—OS"
    rows = [(f"g{i}", good) for i in range(60)] + [(f"b{i}", bad) for i in range(6)] + [("s", "EL BANCO PROCEDERÁ Y TENDRÁ LOS AÑOS")]
    got = {r["id"]: r["restaurado"] for r in garbled_values(spark.createDataFrame(rows, "id string, t string"), "id", ["t"]).collect()}
    assert "s" not in got


def test_one_damage_among_sound_values(spark):
    """Each damage stands alone among two hundred sound values of a corpus."""
    good = "El año está más cerca de aquí que el país; qué RESOLUCIÓN y qué pagaré hay según la decisión"
    bad = {"est·": "está", "RESOLUCI”N": "RESOLUCIÓN", "aqu’": "aquí", "pa’s": "país", "RESOLUCI?N": "RESOLUCIÓN", "resoluciÃ³n": "resolución", "a��o": "año", "qu?": "qué", "m\u00a0s": "más", "Pa�s": "País", "resoluciÃ�n": "resolución"}
    rows = [(f"g{i}", good + " resolución") for i in range(200)] + [(k, f"Un texto con {k} dentro") for k in bad]
    got = {r["id"]: r["restaurado"] for r in garbled_values(spark.createDataFrame(rows, "id string, t string"), "id", ["t"]).collect()}
    assert got == {k: f"Un texto con {v} dentro" for k, v in bad.items()}


def test_words_that_fit_equally_are_left_lost():
    corpus = g._Corpus({"mamá": 50, "mamé": 50, "papá": 90}, 1000, {}, 1, g.Channels())
    assert corpus.score("mam�")[1] == "mam�" and corpus.score("pap�")[1] == "papá"


def test_words_below_the_broadcast_share_are_joined(spark):
    """A word that is known but too rare to be sent to all tasks is joined to the values that need it."""
    rows = [(f"g{i}", "está más aquí según él") for i in range(400)] + [(f"r{i}", "el ñandú corre") for i in range(9)] + [("x", "el √±and√∫ corre")]
    df = spark.createDataFrame(rows, "id string, t string")
    p = g.Channels(word_share=1 / 50)
    words, common, total, *_ = g._statistics(df.selectExpr("id", "t AS text"), p)
    assert "ñandú" not in common and ("ñandú", 9) in {(r["other"], r["n"]) for r in g._rarer(words, common, total, p).collect()}
    assert {r["id"]: r["restaurado"] for r in garbled_values(df, "id", ["t"], p).collect()} == {"x": "el ñandú corre"}


def test_words_that_need_rarer_ones(spark):
    """p3_found: only words with a character outside ASCII are stripped, and the same ones are found as by stripping all."""
    from pyspark.sql import functions as F

    from fojas.llm.garbled_text import _EDGE, _telling_words

    df = spark.createDataFrame([("«año» (niño), 12 plain -é- \tÑu\n.x. é",), ("",), ("plain 1.",), ("\u00a0 \U0001f600! ..ñ..ñ.. (niño)",)], "text string")
    every = F.array_distinct(F.transform(F.split("text", "[ \t\n\r]"), lambda w: F.regexp_replace(w, _EDGE, "")))
    rows = df.select(F.filter(every, lambda w: w.rlike(r"[^\x00-\x7f]")).alias("want"), _telling_words(F.col("text")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and any(r["got"] for r in rows)


def test_readings_that_are_no_text_are_not_scored(monkeypatch):
    """p3_found: a word that has lost nothing can't be filled, so a reading of it that is no UTF-8 needs no score."""
    scored, score = [], g._Corpus.score
    monkeypatch.setattr(g._Corpus, "score", lambda self, token, edges=None: scored.append((token, edges)) or score(self, token, edges))
    corpus = g._Corpus({"resolución": 900, "año": 500}, 1400, {"lól": 900, "lñl": 500}, 1400, g.Channels())
    tokens = g._Tokens(corpus, g.channels())
    options, gain = tokens["resolución,"]
    assert options[0] == score(corpus, "resolución,") and gain == 0
    assert all(g.LOST not in t or edges is not None and None in edges for t, edges in scored) and len(scored) < 20
    assert tokens["resoluciÃ³n"][1] > 3 and tokens["resoluci�n"][0][0][1] == "resolución"
