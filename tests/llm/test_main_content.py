from __future__ import annotations

from pyspark.sql import functions as F

from fojas.llm.main_content import best_run, body_lines, main_content, page_furniture

KINDS = ["Ley", "Decreto", "Circular"]


def page(i):
    head = f"{KINDS[i % 3]} N° {100 + i}-2010 sobre pagos y régimen Zeta{chr(97 + i % 26)}"
    body = [f"Artículo {k}. El banco de la plaza {chr(97 + i % 26)}{k} deberá registrar los bonos y remitir el acta {i * 7 + k} al comité." for k in range(1, 5)]
    lines = [("Inicio | Mapa | Contacto", 0), (f"Inicio » {head}", 0), (head, 1), (f"Publicado por: prensa, {i}", 0), *[(b, 1) for b in body[:2]]]
    lines += [(f"Lea también: Ley N° {i}-1999 sobre otra cosa y régimen Y{i}", 0), *[(b, 1) for b in body[2:]], ("Dado en Sede, a los 3 días. Nombre, presidencia.", 1)]
    lines += [("Noticias recientes", 0), (f"El consejo de la plaza x{i} podrá anular la cuenta. Leer más", 0), ("Aviso legal: sitio sin valor oficial", 0), (f"Usted es el visitante N° {i}", 0)]
    return lines


def test_pages(spark):
    rows = [(f"p{i}", "s", "\n".join(l for l, _ in page(i))) for i in range(40)] + [("p0", "s", "\n".join(l for l, _ in page(0))), ("n", "s", None), ("e", "s", ""), (None, "s", "x")]
    df = spark.createDataFrame(rows, "id string, s string, t string").withColumn("line_no", F.lit("mine"))
    got = page_furniture(df, "id", "t", F.col("s")).collect()
    want = {(f"p{i}", n) for i in range(40) for n, (_, keep) in enumerate(page(i), 1) if not keep}
    found = {tuple(x) for x in got}
    assert len(found) == len(got) and len(found & want) >= 0.97 * len(want) and len(found - want) <= 0.03 * len(want)
    bodies = main_content(df, "id", "t", F.col("s")).collect()
    assert len(bodies) == len(rows) and {x["id"]: x["t"] for x in bodies if x["id"]}["n"] is None and bodies[0].asDict().keys() == {"id", "s", "t", "line_no"}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([("a", "s", "solo texto")], "id string, s string, t string")
    assert page_furniture(df, "id", "t", F.col("s")).count() == 0
    assert page_furniture(df.limit(0), "id", "t", F.col("s")).count() == 0


def test_runs():
    assert best_run([]) == (0, 0) and best_run([-1, -2]) == (0, 0) and best_run([-1, 2, -1, 3, -9, 4]) == (1, 4)
    assert best_run([-9, 1, -3, 4, -1], 1) == (1, 4) and best_run([3, -1, -1], 0) == (0, 1)
    assert body_lines([-1, 5, -2, 5, -1], -1, 9.0, 0.0) == [False, True, False, True, False]
    assert body_lines([-1, 5, -2, 5, -1], -1, 9.0, 3.0) == [False, True, True, True, False]
    assert body_lines([5, -9, 2, 3, -9, 1], 0, 1.0, 0.0) == [True, False, True, True, False, False]


def foreign(i, draw):
    """A German news page: other headings, no closing, menus and teasers of other pages."""
    topics, towns = ["Haushalt", "Verkehr", "Wetter", "Schule", "Hafen", "Wald"], ["Kiel", "Husum", "Plön", "Eutin", "Leck", "Heide"]
    name = lambda k: f"{draw.choice(topics)}: Rat von {draw.choice(towns)} berät über Plan {draw.randint(100, 999)}{k}"
    verbs = ["beschloss gestern eine neue Ordnung für", "hörte am Abend zwei Gutachten über", "vertagte nach langer Rede den Antrag zu", "lobte in der Sitzung die Arbeit an"]
    text = [f"Der Ausschuss in {draw.choice(towns)} {draw.choice(verbs)} {draw.choice(topics)} und Umgebung, wie das Protokoll Nummer {draw.randint(1, 9999)} festhält." for _ in range(draw.randint(2, 6))]
    title = name("a")
    lines = [("Startseite · Politik · Sport · Kultur", 0), ("Anmelden", 0)] + ([(f"Politik > {title}", 0)] if i % 2 else []) + [(title, 1), (f"Von der Redaktion, Stand {draw.randint(1, 28)}.3.2020, {draw.randint(1, 23)} Uhr", 0)]
    for k, t in enumerate(text):
        lines.append((t, 1))
        if k == 0 and i % 3 == 0:
            lines.append((f"Mehr zum Thema: {name('b')}", 0))
    lines += [(f"Teilen ({draw.randint(1, 99)})", 0), ("Mehr aus der Region", 0), (name("c"), 0), (name("d"), 0), (f"Mehr zum Thema: {name('e')}", 0), ("Impressum | Datenschutz", 0)]
    return title, lines


def test_another_language_and_form(spark):
    import random

    draw = random.Random(5)
    made = [foreign(i, draw) for i in range(300)]
    rows = [(i, f"s{i % 3}", t if i % 10 else None, "\n".join(l for l, _ in lines)) for i, (t, lines) in enumerate(made)]
    df = spark.createDataFrame(rows, "id long, s string, titulo string, t string")
    got = {tuple(r) for r in page_furniture(df, "id", "t", F.col("s"), F.col("titulo")).collect()}
    want = {(i, n) for i, (_, lines) in enumerate(made) for n, (_, keep) in enumerate(lines, 1) if not keep}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
