from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fojas import catalog
from fojas.operators import answer, chunking, dense, evaluate, filters, fusion, index, lexical, rerank, search

TEXTS = ["encaje legal del banco", "tipo de cambio y mesa de cambio", "encaje encaje", None, "pagos"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t, ["Ley", "Decreto", "Ley", "Ley", None][i], [f"e{i % 2}"]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "pos long, texto string, tipo_norma string, entidades array<string>")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("a", "encaje legal"), ("b", "cambio cambio"), ("c", "nada"), ("d", None)], "qid string, query string")


def brute(query):
    import re

    docs = [re.findall("[a-z0-9]{2,}", (t or "").lower()) for t in TEXTS]
    docs = [[w[:7] for w in d] for d in docs]
    mean = sum(max(len(d), 1) for d in docs) / len(docs)
    out = {}
    for i, d in enumerate(docs):
        s = 0.0
        for w in query.split():
            n = sum(w[:7] in x for x in docs)
            f = d.count(w[:7])
            if f:
                s += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * max(len(d), 1) / mean))
        if s > 0:
            out[i] = s
    return out


def test_bm25_against_brute_force(corpus, asked):
    ix = lexical.build_index(corpus, "pos", "texto")
    got = {}
    for r in lexical.scores(ix, asked, "qid", "query").collect():
        got.setdefault(r["qid"], {})[r["pos"]] = r["score"]
    for q, t in (("a", "encaje legal"), ("b", "cambio cambio")):
        want = brute(t)
        assert got[q].keys() == want.keys() and all(abs(got[q][k] - want[k]) < 1e-9 for k in want)
    assert "c" not in got and "d" not in got


def test_filters_come_after_scores(corpus, asked):
    ix = lexical.build_index(corpus, "pos", "texto")
    s = lexical.scores(ix, asked, "qid", "query")
    free = {(r["qid"], r["pos"]): r["score"] for r in lexical.best(s, 50).collect()}
    only = lexical.best(s, 50, corpus, "pos", filters.build_filter({"tipo_norma": "Ley"})).collect()
    assert only and all(free[r["qid"], r["pos"]] == r["score"] for r in only) and len(only) < len(free)


def test_filter_parts(spark):
    assert filters.build_filter(None) is None and filters.build_filter({"materia": ""}) is None
    df = spark.sql("SELECT 1 AS n, TIMESTAMP_NTZ'2020-01-01' AS fecha_publicacion, array('x') AS entidades UNION ALL SELECT 2, NULL, NULL")
    assert [r["n"] for r in df.filter(filters.build_filter({"fecha_desde": "2020-01-01", "fecha_hasta": "2020-01-01"})).collect()] == [1]
    assert [r["n"] for r in df.filter(filters.build_filter({"entidades": "x"})).collect()] == [1]
    assert filters.http_filter({"materia": "M", "x": 1}) == {"materia": "M"}


@pytest.mark.parametrize("bad", [{"mode": "x"}, {"limit": 0}, {"limit": 51}, {"limit": 11, "chat": True}, {"alpha": 1.5}, {"alpha": float("nan")}, {"message": " a "}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        filters.checked(**bad)


def test_dense_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 8))
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pos long, vector array<double>")
    q = base.filter("pos % 20 = 0").withColumnRenamed("pos", "qid")
    got = lexical.best(dense.cosine_scores(base, q, 6, block=64).filter("qid <> pos"), 5).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(0, 300, 20) for j in np.argsort(-s[i])[:5] if s[i, j] > 0}
    assert {(r["qid"], r["pos"]) for r in got} == want


def test_fusion_edges(spark):
    lex = spark.createDataFrame([("q", 1, 4.0), ("q", 2, 2.0)], "qid string, pos long, score double")
    den = spark.createDataFrame([("q", 2, 0.5), ("q", 3, 0.25)], "qid string, pos long, score double")
    f = lambda a: {r["pos"]: round(r["score"], 6) for r in fusion.linear(lex, den, a).collect()}
    assert f(0.0) == {1: 1.0, 2: 0.5, 3: 0.0} and f(1.0) == {1: 0.0, 2: 1.0, 3: 0.5} and f(0.7) == {1: 0.3, 2: 0.85, 3: 0.35}
    assert {r["pos"] for r in fusion.candidates(lex, den).collect()} == {1, 2, 3}
    with pytest.raises(ValueError):
        fusion.linear(lex, den, 2)


def test_search_says_what_it_did(corpus, asked):
    bare = search.Corpus(corpus, lexical.build_index(corpus, "pos", "texto"))
    rows = search.search(bare, asked, "hybrid", 2).collect()
    assert rows and {r["modo"] for r in rows} == {"keyword"} and {r["alpha"] for r in rows} == {None}
    full = search.hashed_corpus(corpus, 16)
    rows = search.search(full, asked, "hybrid", 2, filters={"tipo_norma": "Ley"}, rerank=True).collect()
    assert {r["modo"] for r in rows} == {"hybrid"} and {r["tipo_norma"] for r in rows} == {"Ley"}


def test_rerank(spark):
    rows = [("q", 1, "uno"), ("q", 2, "uno dos"), ("q", 3, "dos uno tres"), ("z", 1, "x")]
    c = spark.createDataFrame([(q, i, i, t, "uno dos tres", 1.0) for q, i, t in rows], "qid string, pos long, nth int, texto string, query string, score double")
    got = rerank.rerank(c, "query", "texto", 2).orderBy("qid", "place").collect()
    assert [(r["qid"], r["pos"], r["reranked"]) for r in got] == [("q", 3, True), ("q", 2, True), ("z", 1, False)]
    back = spark.createDataFrame([("q", 2, 0.5), ("q", 9, 1.0)], "qid string, nth int, score double")
    al = {(r["qid"], r["nth"]): r["rerank_score"] for r in rerank.aligned(c.select("qid", "nth"), back).collect()}
    assert al == {("q", 1): float("-inf"), ("q", 2): 0.5, ("q", 3): float("-inf"), ("z", 1): None}


def test_second_stage_of_strategies_reads_whole_texts(spark, tmp_path):
    import duckdb

    objects = [(0, "alfa", "a"), (1, "beta", "b"), (2, "relleno " * 600 + "alfa beta", "c"), (3, "alfa", "d"), (4, "beta", "e"), (5, None, "f")]
    spark.createDataFrame(objects, "pos long, texto string, doc_id string").write.parquet(f"{tmp_path}/normativa.parquet")
    spark.createDataFrame([("alfa beta", "c")], "query string, doc_id_relevante string").write.parquet(f"{tmp_path}/eval_set.parquet")
    con = duckdb.connect()
    for name in ("normativa", "eval_set"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert [tuple(r) for r in catalog.queries()["eval_best"](spark, str(tmp_path)).collect()] == [("hybrid_0.7_rerank", 1.0)]
    assert con.sql(catalog.oracle_sql()["eval_best"]).fetchall() == [("hybrid_0.7_rerank", 1.0)]


def test_strategies_by_words_late_in_texts(spark, tmp_path):
    """Words beyond 2,000 characters count in the second stage, at the very end of a text too; null texts and queries without words don't disturb it."""
    import duckdb

    long = [f"relleno{i} " * (300 + 40 * i) + end for i, end in enumerate(("alfa beta", "beta gamma", "delta"))]
    texts = ["alfa", "beta", *long, "alfa", None, "gamma gamma", "", "beta delta"]
    spark.createDataFrame([(i, x, f"d{i}") for i, x in enumerate(texts)], "pos long, texto string, doc_id string").write.parquet(f"{tmp_path}/normativa.parquet")
    asked = [("alfa beta", "d2"), ("beta gamma", "d3"), ("relleno2 delta", "d4"), (" ", "d6")]
    spark.createDataFrame(asked, "query string, doc_id_relevante string").write.parquet(f"{tmp_path}/eval_set.parquet")
    con = duckdb.connect()
    for name in ("normativa", "eval_set"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    columns = ["estrategia", "recall", "precision", "rr", "ndcg", "consultas"]
    got = sorted(tuple(r) for r in catalog.queries()["eval_by_strategy"](spark, str(tmp_path)).select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(con.sql(f"SELECT {quoted} FROM ({catalog.oracle_sql()['eval_by_strategy']})").fetchall())
    assert {r[0]: r[3] for r in got}["hybrid_0.7_rerank"] == 0.75  # three of four at the first place, the blank query finds none


LAW = "TÍTULO I\nCAPÍTULO II De algo\nArtículo 1. " + "Texto del primer artículo con bastante cuerpo. " * 4 + "\nCapítulo III\nArtículo 2.- " + "Otro cuerpo de artículo que sigue aquí. " * 60


def test_structural_chunks():
    got = chunking.chunks_of(LAW)
    assert {w for w, *_ in got} == {"estructural"} and all(len(p) <= 1800 for *_, p in got)
    labels = [x[2] for x in got]
    assert labels[0] == "Título I · Capítulo II · Artículo 1" and labels[1] == "Título I · Capítulo III · Artículo 2 (parte 1)"
    long = chunking.chunks_of("palabra " * 5000)
    assert {w for w, *_ in long} == {"tamano"} and all(len(p) <= 1800 for *_, p in long)
    assert chunking.chunks_of(None) == [] and chunking.chunks_of(" \n ") == [] and len(chunking.chunks_of("corto")) == 1


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "x", 1), ("q", "x", 2), ("q", "a", 3), ("q", "b", 4)], "qid string, doc_id string, rank int")
    rel = spark.createDataFrame([("q", "a"), ("p", "z")], "qid string, doc_id string")
    got = {r["qid"]: r for r in evaluate.metrics(ranked, rel, 2).collect()}
    assert got["q"]["recall"] == 1.0 and got["q"]["precision"] == 0.5 and got["q"]["rr"] == 0.5 and abs(got["q"]["ndcg"] - 1 / math.log2(3)) < 1e-12
    assert got["p"]["recall"] == got["p"]["rr"] == got["p"]["ndcg"] == 0
    cut = {r["qid"]: r for r in evaluate.metrics(ranked, rel, 2, cut_first=True).collect()}
    assert cut["q"]["recall"] == 0


def test_index_operators(spark):
    docs = spark.createDataFrame([("1", "pdf", "h"), ("2", "pdf", "h"), ("3", "html", "h"), ("4", "pdf", None), ("5", "pdf", None)], "doc_id string, formato string, hash string")
    assert sorted(r["doc_id"] for r in index.unique_documents(docs).collect()) == ["1", "3", "4", "5"]
    pieces = spark.createDataFrame([("1", 0, "a"), ("2", 0, "a"), ("3", 0, "b"), ("4", 0, None)], "doc_id string, chunk_index int, doc_hash string")
    left = index.pending(pieces, spark.createDataFrame([("b",)], "doc_hash string"), [F.col("doc_id")])
    assert sorted(r["doc_id"] for r in left.collect()) == ["1", "4"]
    links = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("x", "y")], "desde string, hasta string")
    assert {(r["url"], r["nivel"]) for r in index.link_closure(links, spark.createDataFrame([("r",)], "url string")).collect()} == {("r", 0), ("a", 1), ("b", 2)}


def test_answers(spark):
    hits = spark.createDataFrame([("q", 1, "Ley", "Art. 1", "M", " uno\ndos "), ("q", 2, None, None, None, None)], "qid string, n int, tipo_norma string, seccion string, materia string, texto string")
    assert answer.context(hits).first()["contexto"] == "[1] Ley — Art. 1 (materia: M)\nuno\ndos\n\n---\n\n[2] Norma\n"
    queries = spark.createDataFrame([("q",), ("none",)], "qid string")
    got = {r["qid"]: r["respuesta"] for r in answer.extractive(hits, queries).collect()}
    assert "**[1] Ley — Art. 1:** «uno dos…»" in got["q"] and got["none"] == answer.NOTHING
    turns = spark.createDataFrame([(1, i, "bot" if i % 2 else "usuario", " " if i == 9 else f"t{i}") for i in range(11)], "conv long, turno long, rol string, contenido string")
    rows = sorted((r["turno"], r["rol"], r["contenido"]) for r in answer.history_window(turns).collect())
    assert [r[0] for r in rows] == [5, 6, 7, 8, 10] and rows[0][1] == "assistant" and rows[1][1] == "user"
