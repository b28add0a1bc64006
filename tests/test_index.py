from __future__ import annotations

from pathlib import Path

import pytest

from fojas import catalog
from fojas.operators import index

DATA = Path("/root/testdata/sf0.001")


def test_closure_follows_long_chains_and_cycles(spark):
    links = [(f"p{i}", f"p{i + 1}") for i in range(30)] + [("p30", "p0"), ("q", "r")]
    found = index.link_closure(spark.createDataFrame(links, "desde string, hasta string"), spark.createDataFrame([("p0",)], "url string"))
    assert sorted(map(tuple, found.collect()), key=lambda x: x[1]) == [(f"p{i}", i) for i in range(31)]


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_nothing_pending_is_indexed(spark):
    s = str(DATA)
    got = [r["doc_hash"] for r in catalog.queries()["incremental_pending"](spark, s).collect()]
    pieces, indexed = ([r[0] for r in spark.read.parquet(f"{s}/{t}.parquet").select("doc_hash").collect()] for t in ("chunks_ner", "normativa"))
    want = set(pieces) - set(indexed) - {None}
    assert want and {h for h in got if h is not None} == want and len([h for h in got if h is not None]) == len(want)
