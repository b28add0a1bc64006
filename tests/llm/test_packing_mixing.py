from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fojas.llm.mixing import Mix, margins, mixed
from fojas.llm.packing import Pack, fill_report, packed, plan
from fojas.llm.tokens import RANKS, encoding

P = Pack(capacity=64, window=4, rank_rows=7)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=40))
def test_plan_uses_up_the_histogram(histogram):
    used = Counter()
    for parts, n in plan(histogram, P):
        assert n > 0 and sum(parts) <= P.capacity
        for s in parts:
            used[s] += n
    assert used == Counter(histogram)


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    histogram = Counter(np.clip(rng.lognormal(3, 0.9, 20_000).astype(int), 1, 64).tolist())
    need = sum(s * n for s, n in histogram.items())
    assert sum(n for _, n in plan(histogram, P)) * P.capacity <= 1.015 * need


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["ley", "pago", "banco", "x1"][j] for j in rng.integers(0, 4, int(n))), ["a", "b", "c", None][i % 4], ["es", None, "en"][i % 3]) for i, n in enumerate(rng.integers(0, 90, 300))]
    return spark.createDataFrame([*rows, (900, None, "a", "es"), (901, "", "b", "es"), (902, "palabra " * 400, "c", "en")], "id long, text string, source string, lang string")


def test_packed(docs):
    got = packed(docs.withColumn("tokens", F.lit("mine")), "id", "text", P).collect()
    sizes, load = Counter(), Counter()
    for r in got:
        sizes[r["id"]] += r["tokens"]
        load[r["contenedor"]] += r["tokens"]
    enc = encoding(RANKS)
    assert {r["id"]: len(enc.encode_ordinary(r["text"] or "")) for r in docs.collect()} == dict(sizes)
    assert max(load.values()) <= 64 and len({(r["id"], r["pieza"]) for r in got}) == len(got)
    assert all(r["pieza"] == 0 for r in got if sizes[r["id"]] <= 64) and all(r["desde"] == 64 * r["pieza"] for r in got)
    assert sum(load.values()) / (64 * len([x for x in load.values() if x])) > 0.97
    one = fill_report(packed(docs, "id", "text", P), P).first()
    assert one["mas_lleno"] <= 64 and one["tokens"] == sum(load.values())


def test_packing_nothing(docs):
    assert packed(docs.limit(0), "id", "text", P).count() == 0


def goals(spark, rows):
    return spark.createDataFrame(rows, "source string, share double, cap int")


def test_mixed(spark, docs):
    uses, shares = mixed(docs, "id", "text", "source", F.col("lang"), F.lit(None), goals(spark, [("a", 0.6, 3), ("b", 0.3, 2), ("gone", 0.1, 2)]))
    rows, got = uses.collect(), {r["source"]: r for r in shares.collect()}
    assert len(rows) == docs.count() and all(r["uses"] <= {"a": 3, "b": 2}.get(r["source"], 0) for r in rows)
    assert abs(got["a"]["reached"] - 2 / 3) < 0.01 and abs(got["b"]["reached"] - 1 / 3) < 0.01 and got["gone"]["reached"] == 0


def test_mix_short_of_text(spark, docs):
    uses, shares = mixed(docs, "id", "text", "source", F.col("lang"), F.lit("t"), goals(spark, [("a", 0.9, 1), ("b", 0.1, 4)]), Mix(total=10_000_000))
    assert {r["uses"] for r in uses.filter("source = 'a' AND tokens > 0").collect()} == {1} and shares.count() == 2
    none, empty = mixed(docs.limit(0), "id", "text", "source", F.col("lang"), F.lit("t"), goals(spark, [("a", 1.0, 1)]))
    assert none.count() == 0 and empty.first()["reached"] == 0


def test_margins_and_the_source_that_limits(spark, docs):
    targets = goals(spark, [("a", 0.6, 3), ("b", 0.4, 3)])
    uses, shares = mixed(docs, "id", "text", "source", F.col("lang"), F.lit(None), targets)
    assert sum(r["limits"] for r in shares.collect()) == 1
    got = {(r["side"], r["value"]): r for r in margins(uses, targets).collect()}
    assert abs(sum(r["target"] for (side, _), r in got.items() if side == "lang") - 1) < 1e-9
    assert abs(sum(r["reached"] for (side, _), r in got.items() if side == "lang") - 1) < 1e-9
    assert all(abs(r["target"] - r["reached"]) < 0.05 for r in got.values())
