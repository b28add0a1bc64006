"""Results that must not depend on cuts: long chains, late ranks, pruned fusion, counted places."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fojas.operators import chunking, evaluate, fusion, index, lexical
from fojas.plans import lineage


def test_a_chain_of_links_is_followed_to_its_end(spark):
    links = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(40)] + [("p40", "p0")], "desde string, hasta string")
    got = {r["url"]: r["nivel"] for r in index.link_closure(links, spark.createDataFrame([("p0",)], "url string")).collect()}
    assert got == {f"p{i}": i for i in range(41)}


def test_a_relevant_document_at_rank_60(spark):
    scored = spark.createDataFrame([("q", i, 1.0 - i / 200) for i in range(100)] + [("q", 500, 2.0), ("z", 1, 0.0)], "qid string, pos long, score double")
    docs = spark.createDataFrame([(i, f"d{i}") for i in range(100)] + [(500, "d3")], "pos long, doc_id string")
    relevant = spark.createDataFrame([("q", "d59"), ("q", "nowhere"), ("z", "d1")], "qid string, doc_id string")
    places = evaluate.relevant_places(scored, docs, relevant)
    assert [tuple(r) for r in places.select("qid", "doc_id", "rank").collect()] == [("q", "d59", 60)]
    got = {r["qid"]: r for r in evaluate.measures(places, relevant, 5).collect()}
    assert abs(got["q"]["rr"] - 1 / 60) < 1e-12 and got["q"]["recall"] == 0 and got["z"]["rr"] == 0


@pytest.mark.parametrize("alpha", [0.0, 0.3, 0.7, 1.0])
def test_pruned_fusion_equals_all_pairs(spark, alpha):
    from fojas.operators.dense import cosine_scores

    draw = random.Random(3)
    vectors = spark.createDataFrame([(i, [draw.gauss(0, 1) for _ in range(4)]) for i in range(300)], "pos long, vector array<double>")
    queries = spark.createDataFrame([(f"q{i}", [draw.gauss(0, 1) for _ in range(4)]) for i in range(6)], "qid string, vector array<double>")
    words = spark.createDataFrame([(f"q{q}", p, draw.choice([1.0, 2.0, draw.random() * 5])) for q in range(8) for p in range(310) if draw.random() < 0.4], "qid string, pos long, score double")
    want = lexical.best(fusion.linear(words, cosine_scores(vectors, queries), alpha), 7).collect()
    got = fusion.best_linear(words, vectors, queries, alpha, 7).collect()
    plain = lambda rows: sorted((r["qid"], r["nth"], r["pos"], round(r["score"], 9)) for r in rows)
    assert plain(got) == plain(want) and got


def test_pruned_fusion_of_allowed_rows(spark):
    from fojas.operators.dense import cosine_scores

    draw = random.Random(5)
    vectors = spark.createDataFrame([(i, [draw.gauss(0, 1) for _ in range(4)]) for i in range(200)], "pos long, vector array<double>")
    queries = spark.createDataFrame([(f"q{i}", [draw.gauss(0, 1) for _ in range(4)]) for i in range(5)], "qid string, vector array<double>")
    words = spark.createDataFrame([(f"q{q}", p, draw.random() * 5) for q in range(7) for p in range(210) if draw.random() < 0.4], "qid string, pos long, score double")
    allowed = spark.range(0, 210, 7).select(F.col("id").alias("pos"))
    whole = fusion.linear(words, cosine_scores(vectors, queries), 0.6).join(allowed, "pos", "left_semi")
    plain = lambda rows: sorted((r["qid"], r["nth"], r["pos"], round(r["score"], 9)) for r in rows)
    got = plain(fusion.best_linear(words, vectors, queries, 0.6, 6, allowed).collect())
    assert got == plain(lexical.best(whole, 6).collect()) and got
    assert fusion.best_linear(words, vectors, queries, 0.6, 6, allowed.limit(0)).count() == 0


def test_ranks_over_ranges_equal_one_sort(spark):
    draw = random.Random(2)
    rows = [(None if q == 3 else f"q{q}", p, draw.choice([0.0, 0.5, draw.random(), -1.0])) for q in range(5) for p in range(300 if q == 1 else 9)]
    got = fusion.ranks(spark.createDataFrame(rows, "qid string, pos long, score double").filter("qid IS NOT NULL")).collect()
    want = []
    for q in {r[0] for r in rows} - {None}:
        kept = sorted((-round(s, 9), p) for i, p, s in rows if i == q and s > 0)
        want += [(q, p, n) for n, (_, p) in enumerate(kept, 1)]
    assert sorted((r["qid"], r["pos"], r["rank"]) for r in got) == sorted(want)


def test_approximate_search_finds_nine_in_ten(spark):
    import numpy as np

    from fojas.operators import approximate

    rng = np.random.default_rng(4)
    v = rng.standard_normal((40, 24))[rng.integers(0, 40, 1600)] + 0.4 * rng.standard_normal((1600, 24))
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pos long, vector array<double>")
    asked = base.filter("pos % 20 = 0").withColumnRenamed("pos", "qid")
    ix = approximate.build_lists(base, sample=800)
    assert sum(ix.sizes.values()) == 1600
    found = {(r["qid"], r["pos"]) for r in lexical.best(approximate.nearest(ix, asked, 6, block=64).filter("qid <> pos"), 5).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(0, 1600, 20) for j in np.argsort(-s[i])[:5]}
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)
    none = approximate.build_lists(base.limit(0))
    assert approximate.nearest(none, asked, 6).count() == 0


def test_coverage_of_written_forms(spark):
    rows = [("Las leyes y el decreto", ["norma:ley", "norma:Decreto"]), ("LEYES de 1999", ["norma:leyes"]), ("una ley", None), (None, ["norma:ley"])]
    tagged = spark.createDataFrame(rows, "texto string, entidades array<string>")
    got = evaluate.form_coverage(tagged, [("norma", "leyes"), ("norma", "decreto"), ("otra", "ley")], {"m": F.col("entidades")}).collect()
    assert {(r["etiqueta"], r["forma"], r["n"], r["por_raiz"], r["literal"]) for r in got} == {
        ("norma", "leyes", 2, 1, 1), ("norma", "decreto", 1, 1, 1), ("otra", "ley", 3, 0, 0), (None, None, 6, 2, 2)
    }


def test_windows_end_at_the_last_space_of_their_tail():
    draw = random.Random(1)
    s = chunking.Sizes(most=40, overlap=9)
    for _ in range(300):
        text = "".join(draw.choice("ab ") if draw.random() < 0.5 else "x" for _ in range(draw.randint(0, 200)))
        spans = list(chunking.size_spans(text, s))
        assert bool(spans) == bool(text) and (not spans or spans[0][0] == 0 and spans[-1][1] == len(text))
        for k, (a, b) in enumerate(spans):
            assert 0 < b - a <= 40
            if k + 1 < len(spans):
                assert spans[k + 1][0] == max(b - 9, a + 1)
                inside = [i for i in range(a + 24, a + 40) if text[i] == " "]
                assert b == (inside[-1] if inside else a + 40)


def test_systematic_sample(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert sorted(r["k"] for r in index.systematic_sample(rows, [F.col("k")], 90).collect()) == list(range(0, 1000, 12))
    assert index.systematic_sample(rows, [F.col("k")], 5000).count() == 1000 and index.systematic_sample(rows.limit(0), [F.col("k")], 5).count() == 0


def test_pieces_without_a_vector_can_be_an_error(spark):
    pieces = spark.createDataFrame([("a", " uno "), ("b", "dos")], "doc_id string, texto string")
    objects = spark.createDataFrame([(1, "uno", [1.0])], "pos long, texto string, vector array<double>")
    assert index.vectors_by_text(pieces, objects)[1].count() == 1
    with pytest.raises(ValueError):
        index.vectors_by_text(pieces, objects, whole=True)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def __init__(self, **kept):
            self.kept = kept

        def get(self, key, other=None):
            return self.kept.get(key, other)

    class Session:
        conf = Conf(**{"spark.master": "yarn"})

    with pytest.raises(ValueError):
        lineage.shared_dir(Session())
