"""Searches and evaluations that take all scores in blocks, against those that make a row for every pair."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fojas import catalog
from fojas.operators import dense, evaluate, fusion, lexical, scan

NO_PAIRS = (
    "bm25_topk",
    "bm25_filtered",
    "bm25_log",
    "rerank_align_missing",
    "eval_metrics_cut_first",
    "eval_metrics",
    "candidate_union",
    "hybrid_alpha0",
    "hybrid_alpha1",
    "hybrid_linear",
    "hybrid_rrf",
    "eval_models",
    "eval_best",
    "eval_by_strategy",
)


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_table_of_all_pairs(spark, monkeypatch, name):
    def refuse(*args, **kwargs):
        raise AssertionError("a row for every pair")

    for module, function in ((lexical, "scores"), (dense, "cosine_scores"), (fusion, "linear")):
        monkeypatch.setattr(module, function, refuse)
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count()


@pytest.fixture()
def small_blocks(monkeypatch):
    """Seven blocks of rows, two of queries."""
    for name, value in (("LEAST", 16), ("TASKS", 7), ("QUERIES", 6)):
        monkeypatch.setattr(scan, name, value)


@pytest.fixture(scope="module")
def drawn(spark):
    """Rows (pos, texto, doc_id) with repeated texts, empty ones and nulls, and queries (qid, query)."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(12)] + ["rara", "única"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    rows = [(i, draw.choice([None, "", "w1 w2", text(5), text(draw.randint(1, 20))]), f"d{i // 3}" if i % 11 else None) for i in range(150)]
    asked = [(f"q{i}", text(draw.randint(1, 4))) for i in range(9)] + [("none", "zzz"), ("null", None), ("twice", "w1 w1 w2")]
    return spark.createDataFrame(rows, "pos long, texto string, doc_id string"), spark.createDataFrame(asked, "qid string, query string")


@pytest.fixture(scope="module")
def hashed(drawn):
    """Vectors of the rows and queries, without those of null and empty texts."""
    from fojas.functions.vectors import hash_encode

    def of(df, key, text):
        coded = hash_encode(F.regexp_replace(text, r"\b(w\d)\b", "$1x"), 5)
        return df.select(key, coded.alias("vector")).filter(F.exists("vector", lambda x: x != 0))

    return of(drawn[0], "pos", "texto"), of(drawn[1], "qid", "query")


def _plain(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_best_words(drawn, small_blocks):
    rows, asked = drawn
    ix = lexical.build_index(rows, "pos", "texto")
    scored = lexical.scores(ix, asked, "qid", "query")
    want = _plain(lexical.best(scored, 4), "qid", "nth", "pos", "score")
    assert want and _plain(lexical.best_of(ix, asked, "qid", "query", 4), "qid", "nth", "pos", "score") == want
    allowed = rows.filter("pos % 3 = 1").select("pos")
    want = _plain(lexical.best(scored, 4, rows, "pos", F.col("pos") % 3 == 1), "qid", "nth", "pos", "score")
    assert want and _plain(lexical.best_of(ix, asked, "qid", "query", 4, allowed), "qid", "nth", "pos", "score") == want


def test_documents_hold_the_postings(drawn):
    rows = drawn[0]
    found = _plain(lexical.build_index(rows, "pos", "texto").postings, "pos", "term", "f", "dl")
    assert found == _plain(lexical.postings(rows, "pos", "texto").filter("term IS NOT NULL"), "pos", "term", "f", "dl")


def test_places_by_words(drawn, small_blocks):
    rows, asked = drawn
    ix = lexical.build_index(rows, "pos", "texto")
    relevant = rows.crossJoin(asked.select("qid")).filter("pos % 5 = 0").select("qid", "doc_id")
    want = evaluate.relevant_places(lexical.scores(ix, asked, "qid", "query"), rows, relevant)
    docs = ix.documents.join(rows.select("pos", F.col("doc_id").alias("doc")), "pos")
    got = evaluate.counted_places(docs, lexical.asked_words(ix, asked, "qid", "query"), ["word"], relevant, ix.mean_length)
    assert _plain(got, "qid", "doc_id", "rank") == _plain(want, "qid", "doc_id", "rank") and want.count() > 50


@pytest.mark.parametrize("alpha", [0.0, 0.7, 1.0])
def test_best_fused(drawn, hashed, small_blocks, alpha):
    rows, asked = drawn
    ix = lexical.build_index(rows, "pos", "texto")
    want = lexical.best(fusion.linear(lexical.scores(ix, asked, "qid", "query"), dense.cosine_scores(*hashed), alpha), 6)
    got = fusion.best_fused(*fusion.both_parts(ix, asked, *hashed), alpha, 6, ix.mean_length)
    assert _plain(got, "qid", "nth", "pos", "score") == _plain(want, "qid", "nth", "pos", "score") and want.count() > 40


@pytest.mark.parametrize(("alpha", "k"), [(0.5, 60), (0.5, 1), (0.8, 3), (0.0, 5)])
def test_best_reciprocal(drawn, hashed, small_blocks, alpha, k):
    """With a small k the first places of both lists are few, so most rows get their other place counted."""
    rows, asked = drawn
    ix = lexical.build_index(rows, "pos", "texto")
    want = lexical.best(fusion.reciprocal_rank(lexical.scores(ix, asked, "qid", "query"), dense.cosine_scores(*hashed), alpha, k), 6)
    got = fusion.best_reciprocal(*fusion.both_parts(ix, asked, *hashed), 6, ix.mean_length, alpha, k)
    assert _plain(got, "qid", "nth", "pos", "score") == _plain(want, "qid", "nth", "pos", "score") and want.count() > 40


def test_best_deep(drawn, hashed, monkeypatch):
    """Two passes over many blocks leave out rows, but none of the k best."""
    for name, value in (("LEAST", 8), ("TASKS", 16), ("QUERIES", 6)):
        monkeypatch.setattr(scan, name, value)
    rows, asked = drawn
    ix = lexical.build_index(rows, "pos", "texto")
    parts, kinds = fusion.both_parts(ix, asked, *hashed), ["word", "cosine"]
    whole, deep = (f(*parts, kinds, 12, ix.mean_length) for f in (scan.best, scan.best_deep))
    for i in (0, 1):
        want, got = (_plain(lexical.best(x.filter(F.col("kind") == i), 12), "qid", "nth", "pos", "score") for x in (whole, deep))
        assert want and got == want
    assert deep.count() < whole.count()


def test_alpha1_reads_no_words(spark, monkeypatch):
    """words have no weight, so there is no index."""
    def refuse(*args, **kwargs):
        raise AssertionError("words are not needed")

    monkeypatch.setattr(lexical, "build_index", refuse)
    assert catalog.queries()["hybrid_alpha1"](spark, "/root/testdata/sf0.001").count()


def test_best_moves_no_rows(spark, drawn, hashed):
    """rows and queries are scored without a shuffle, and with a vector from the pass that counts words."""
    rows, asked = drawn
    ix = lexical.build_index(rows, "pos", "texto", 5)
    queries = fusion.asked_parts(ix, asked, hashed[1])
    found = scan.best(ix.documents, queries, ["word", "cosine"], 3, ix.mean_length)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count()


def test_counts_equal_the_encoder():
    import re
    from collections import Counter

    import pyarrow as pa

    from fojas.functions import counts
    from fojas.functions.vectors import _WORD, _Places

    draw, one, places = random.Random(1), re.compile("([a-z0-9]{2,7})[a-z0-9]*"), _Places(5)
    texts = ["".join(draw.choice("abcz09 .-ñ\n") for _ in range(draw.choice([0, 1, 2, 5, 30, 200]))) for _ in range(200)] + ["x" * 70 + " " + "ab1" * 40, ""]
    got = counts.counted(pa.array(["before", *texts]).slice(1), 7, 5)
    for i, t in enumerate(texts):
        c, v = Counter(one.findall(t)), [0.0] * 5
        for w in _WORD.findall(t):
            v[places[w]] += 1
        assert (got["terms"][i].as_py(), got["f"][i].as_py(), got["dl"][i].as_py()) == (list(c), list(c.values()), max(c.total(), 1))
        assert got["vector"][i].as_py() == (v if any(v) else None)


def test_places_and_best_from_one_scan(drawn, hashed, small_blocks, monkeypatch):
    """what stands ahead and the best rows come from the same scores."""
    rows, asked = drawn
    ix = lexical.build_index(rows, "pos", "texto", 5, {"doc": "doc_id"})
    queries = fusion.with_tops(ix.documents, fusion.asked_parts(ix, asked, hashed[1]), ix.mean_length)
    relevant = rows.crossJoin(asked.select("qid")).filter("pos % 5 = 0").select("qid", "doc_id")
    parts = (ix.documents, queries, ["word", 0.7], relevant)
    want = _plain(evaluate.counted_places(*parts, ix.mean_length), "kind", "qid", "doc_id", "rank")
    top = lexical.best(scan.best(ix.documents, queries, [0.7], 4, ix.mean_length), 4)
    places, best = evaluate.counted_places_and_best(*parts, (1, 4), ix.mean_length)
    assert want and _plain(places, "kind", "qid", "doc_id", "rank") == want
    assert _plain(lexical.best(best, 4), "qid", "nth", "pos", "score") == _plain(top, "qid", "nth", "pos", "score")


@pytest.mark.parametrize("signed", [False, True])
def test_single_precision_rules_out_no_result(signed):
    """F14 hybrid_linear: what single precision leaves for double precision holds the best rows, ties and near ties among them."""
    draw = np.random.default_rng(3)
    n, queries, words = 700, 9, [f"w{i}" for i in range(40)]
    terms = [sorted(draw.choice(words, draw.integers(0, 12), replace=False).tolist()) for _ in range(n)]
    v = draw.integers(-2 if signed else 0, 3, (n, 6)).astype(float)
    v[::7] = v[0] * (1 + 1e-12)  # nearly equal rows
    terms[::7] = [terms[0]] * len(terms[::7])
    rows = pa.table({
        "pos": pa.array(draw.permutation(n)), "dl": pa.array(draw.integers(1, 4, n) if signed else np.full(n, 5), pa.int32()), "terms": pa.array(terms, pa.list_(pa.string())),
        "f": pa.array([[1 + i % 3 for i in range(len(t))] for t in terms], pa.list_(pa.int32())), "vector": pa.array([x if x.any() else None for x in v], pa.list_(pa.float64())),
    })
    own = [sorted(draw.choice([*words, "none"], i, replace=False).tolist()) for i in range(queries)]
    asked = pa.table({
        "qid": pa.array([f"q{i}" for i in range(queries)]), "words": pa.array([x or None for x in own], pa.list_(pa.string())), "weights": pa.array([[0.1 + j for j in range(len(x))] or None for x in own], pa.list_(pa.float64())),
        "vector": pa.array([*(v[5 : 5 + queries - 1] + 1.0), None], pa.list_(pa.float64())), "top_word": pa.array([None, *range(1, queries)], pa.float64()), "top_cosine": pa.array([1e-40, *[0.9] * (queries - 1)], pa.float64()),
    })
    b = scan._Block(rows, scan._Asked(asked), 2.0)
    for kind in ("word", "cosine", 0.0, 0.7, 1.0):
        whole = np.concatenate([s.copy() for _, _, s in b.scores([kind])])
        q, r = (x.ravel() for x in np.indices(whole.shape))
        assert np.allclose(b.exact(kind, q, r), whole.ravel(), rtol=1e-12, atol=1e-14)
        for k in (1, 10):
            want = scan._ordered(q, r, whole.ravel(), k)
            near = [(a + lo, c) for lo, s, error, above in b.rough(kind) for a, c in [scan._near_first(s, k, error, above, 0.0)]]
            a, c = map(np.concatenate, zip(*near, strict=True))
            found = scan._ordered(a, c, whole[a, c], k)
            assert all((x == y).all() for x, y in zip(found, want, strict=True)) and len(want[0])
