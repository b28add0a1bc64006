from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from fojas.llm.near_duplicates import Near, all_pairs, fewest_matches, near_duplicate_groups


def shingles(t, n):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def texts(n=40):
    rng = np.random.default_rng(2)
    out = []
    for i in range(n):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        out.append((f"a{i:02}", " ".join(base)))
        cut = int(rng.integers(1, 40))
        out.append((f"b{i:02}", " ".join(base[: 120 - cut] + [f"n{x}" for x in range(cut // 2)])))
        out.append((f"c{i:02}", "  ".join(base).upper()))
    return out + [("e1", None), ("e2", ""), ("e3", "dos palabras"), ("e4", ""), ("a00", out[0][1])]


def test_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "id string, t string").withColumn("class", F.lit(1)).withColumn("n", F.lit("x"))
    s = {i: shingles(t, 3) for i, t in rows}
    ids = sorted(s)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.6}
    for p in (Near(words=3, threshold=0.6), Near(words=3, threshold=0.6, bucket=1), Near(words=3, threshold=0.6, bucket=1, large=1)):
        got = [tuple(x) for x in all_pairs(df, "id", "t", p).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.98 * len(want)


def test_groups(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, base if i < 6 else base + " " + " ".join(f"z{i}{k}" for k in range(3))) for i in range(9)] + [(20, "otra cosa muy distinta de todo lo demás"), (21, None)]
    got = {x["id"]: (x["class"], x["group"], x["links"]) for x in near_duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert {got[i][1] for i in range(9)} == {0} and {got[i][0] for i in range(6)} == {0} and got[0][2] == 3
    assert got[20] == (20, 20, 0) and got[21] == (21, 21, 0) and len(got) == 11


def test_empty(spark):
    df = spark.createDataFrame([], "id string, t string")
    assert all_pairs(df, "id", "t").count() == 0 and near_duplicate_groups(df, "id", "t").count() == 0


def test_limits_rise_and_spare_true_pairs():
    need = fewest_matches(Near(threshold=0.6))
    assert all(a[1] <= b[1] for a, b in zip(need, need[1:], strict=False)) and need[-1][1] < 0.6 * need[-1][0]


def test_long_chain_is_one_group(spark):
    rng = np.random.default_rng(3)
    words, ids = [f"w{i}" for i in range(4 * 1000 + 60)], rng.permutation(1000)
    rows = [(int(x), " ".join(words[4 * i : 4 * i + 60])) for i, x in enumerate(ids)]  # similarity 0.87 to the next, 0.75 to the one after
    got = near_duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert sum(r["links"] for r in got) == 2 * 999 and sorted(r["id"] for r in got) == list(range(1000))
    groups = {r["group"] for r in got}
    assert groups == {0}, f"{len(groups)} groups"


def test_a_notice_in_every_text(spark):
    """A notice that all texts share makes bands of all of them; only texts that are alike in the rest are paired."""
    rng = np.random.default_rng(7)
    notice = " ".join(f"aviso{i}" for i in range(80))
    rows = []
    for i in range(120):
        own = [f"w{x}" for x in rng.integers(0, 100_000, 60)]
        rows += [(f"a{i:03}", notice + " " + " ".join(own)), (f"b{i:03}", notice + " " + " ".join(own[:52] + ["x", "y"]))]
    df = spark.createDataFrame(rows, "id string, t string")
    s = {i: shingles(t, 3) for i, t in rows}
    ids = sorted(s)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.6}
    got = {tuple(x) for x in all_pairs(df, "id", "t", Near(words=3, threshold=0.6, bucket=16, large=32)).collect()}
    assert got == want and len(want) == 120
