"""Approximate cosine search of a set of queries: inverted lists around centroids, exact cosines within the lists probed."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fojas.functions.vectors import l2_normalize
from fojas.operators.dense import block_scores
from fojas.plans.lineage import broadcast_if_small, written


@dataclass(frozen=True)
class Lists:
    """``rows (pos, vector, list)`` of every indexed row, the centroids, and how many rows each list holds."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: dict[int, int]


def _placed(df: DataFrame, key: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """(key, vector, list): each row once for each of the ``probes`` lists nearest to it."""
    kind, width = df.schema[key].dataType.simpleString(), min(probes, len(centroids))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column("vector").flatten().to_numpy().reshape(b.num_rows, -1)
                near = np.argpartition(-(v @ centroids.T), width - 1, axis=1)[:, :width]
                at = pa.array(np.repeat(np.arange(b.num_rows), width))
                yield pa.record_batch({key: b.column(key).take(at), "vector": b.column("vector").take(at), "list": pa.array(near.ravel().astype(np.int32))})

    return df.select(key, l2_normalize(F.col("vector")).alias("vector")).mapInArrow(place, f"{key} {kind}, vector array<double>, list int")


def build_lists(base: DataFrame, sample: int = 20_000, most_lists: int = 1_024, rounds: int = 8, seed: int = 7) -> Lists:
    """An index of ``base (pos, vector)``, usable vectors of one length; every row is indexed, in the list of its nearest centroid.

    Centroids, about the root of the number of rows and at most ``most_lists``, are fitted on about ``sample`` rows, drawn by the hash of pos.
    An empty table gives one empty list.
    """
    n = base.count()
    if not n:
        return Lists(base.select("pos", F.col("vector").cast("array<double>").alias("vector"), F.lit(0).alias("list")), np.zeros((1, 1)), {})
    share = F.pmod(F.xxhash64("pos"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / n) * (1 << 30)))
    some = written(base.filter(share).select(array_to_vector(l2_normalize(F.col("vector"))).alias("features")), "sample")
    some = some if some.limit(1).count() else base.select(array_to_vector(l2_normalize(F.col("vector"))).alias("features"))
    k = int(np.clip(math.isqrt(n), 2, most_lists))
    model = KMeans(k=k, maxIter=rounds, seed=seed, initMode="random").fit(some)
    centroids = np.array(model.clusterCenters())
    centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    rows = written(_placed(base, "pos", centroids, 1), "lists")
    return Lists(rows, centroids, {r["list"]: r["count"] for r in rows.groupBy("list").count().collect()})  # a row for each list


def nearest(index: Lists, queries: DataFrame, k: int, probes: int = 12, block: int = 4_096) -> DataFrame:
    """(qid, pos, score): the cosines above zero that may be among the k best of ``queries (qid, vector)``, for ``lexical.best``.

    A query looks into its ``probes`` nearest lists; all rows of these are compared. A list, or its queries, beyond ``block`` is cut into
    several tasks, each of which keeps at least the k best of every query.
    """
    spark, rows = queries.sparkSession, index.rows
    asked = written(_placed(queries, "qid", index.centroids, probes), "asked") if index.sizes else queries.select("qid", F.col("vector").cast("array<double>").alias("vector"), F.lit(0).alias("list"))
    loads = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}  # a row for each list
    cuts = [(i, math.ceil(n / block), math.ceil(loads.get(i, 1) / block)) for i, n in index.sizes.items()]
    cuts = broadcast_if_small(spark.createDataFrame(cuts, "list int, parts int, slices int"))
    pos, qid = rows.schema["pos"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()

    def spread(df: DataFrame, key: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        df = df.join(cuts, "list").withColumn(own, F.pmod(F.xxhash64(key), F.col(own_n)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))

    left = spread(rows, "pos", "part", "parts", "slice", "slices").select("pos", F.lit(None).cast(qid).alias("qid"), "list", "part", "slice", "vector")
    right = spread(asked, "qid", "slice", "slices", "part", "parts").select(F.lit(None).cast(pos).alias("pos"), "qid", "list", "part", "slice", "vector")
    return left.unionByName(right).groupBy("list", "part", "slice").applyInArrow(lambda t: block_scores(t, k), f"qid {qid}, pos {pos}, score double")
