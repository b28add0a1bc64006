from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from fojas.llm import repeated_lines as r


def brute(rows, least):
    docs, where = defaultdict(set), {}
    for i, site, text in rows:
        if None in (i, site, text):
            continue
        for n, line in enumerate(text.split("\n"), 1):
            key = re.sub("[0-9]+", "0", " ".join(line.lower().split()))
            if key:
                docs[site, key].add(i)
                where[i, n] = site, key
    return {p for p, k in where.items() if len(docs[k]) >= least}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["aviso", "Legal", "nota", "pie", "12", "345", "párrafo\xa0largo", "X"]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choice(words, rng.integers(0, 5))) + ("  " if rng.random() < 0.3 else "") for _ in range(6)]
        if i % 3 == 0:
            lines.insert(2, f"Aviso  LEGAL {i} " + "texto de un aviso muy largo que se repite en cada página " * 12)
        rows.append((f"d{i}", f"s{i % 2}", "\n".join(lines)))
    rows += [rows[0], rows[1], ("n1", None, "aviso"), ("n2", "s0", None), (None, "s0", "aviso"), ("n3", "s0", ""), ("n4", "s0", "x" * 300_000)]
    df = spark.createDataFrame(rows, "id string, s string, t string").withColumn("line_no", F.lit("mine")).withColumn("source", F.lit(1))
    got = [tuple(x) for x in r.repeated_lines(df, "id", "t", F.col("s"), 5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5) and got


def test_cleaning_keeps_rows_and_columns(spark):
    rows = [(i, "s", f"pie\nuno {chr(97 + i)}\n\npie") for i in range(5)] + [(9, None, "pie"), (10, "s", None)]
    df = spark.createDataFrame(rows, "id long, lines_gone string, t string")
    got = {x["id"]: x["t"] for x in r.without_repeated_lines(df, "id", "t", F.col("lines_gone"), 5).collect()}
    assert got == {**{i: f"uno {chr(97 + i)}\n" for i in range(5)}, 9: "pie", 10: None}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, t string, s string")
    assert r.repeated_lines(df, "id", "t", F.col("s")).count() == 0


def test_chunks_depend_on_the_line_alone():
    line = " ".join(f"palabra {chr(97 + i % 26)}{i * i}{chr(97 + i * 7 % 26)}x" for i in range(80))
    alone, among = r._Cut([line]), r._Cut(["otra cosa\n" + line.upper() + "\nfin"])
    assert len(alone.chunks()) > 1 and set(alone.chunks()) <= set(among.chunks())


def test_chunk_counts_decide(spark, monkeypatch):
    rows = [(i, "s", f"un aviso corto\nlínea {chr(97 + i)}") for i in range(6)]
    df = spark.createDataFrame(rows, "id long, s string, t string")
    assert r.repeated_lines(df, "id", "t", F.col("s"), 6).count() == 6
    without = r.repeated_chunks
    monkeypatch.setattr(r, "repeated_chunks", lambda base, n: without(base, n).limit(0))
    assert r.repeated_lines(df, "id", "t", F.col("s"), 6).count() == 0


def test_a_line_and_the_beginning_of_a_longer_one(spark):
    """A line that ends just where a chunk would is told from the longer line that begins with it."""
    words = " ".join(f"palabra {chr(97 + i % 26)}{chr(97 + i * i % 26)}x" for i in range(200))
    cut = r._Cut([words])
    first = int(cut.chunk_start[1])
    rows = [(f"a{i}", "s", words[:first]) for i in range(3)] + [(f"b{i}", "s", words) for i in range(3)]
    df = spark.createDataFrame(rows, "id string, s string, t string")
    assert r.repeated_lines(df, "id", "t", F.col("s"), 4).count() == 0 and r.repeated_lines(df, "id", "t", F.col("s"), 3).count() == 6
