"""Incremental forms: new pieces into an index, and the query log by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def new_pieces(stream: DataFrame, time_col: str, lateness: str = "2 days") -> DataFrame:
    """Pieces whose hash wasn't seen within the lateness; the state is dropped behind the watermark. Null hashes all pass."""
    marked = stream.withColumn("event_time", F.col(time_col).cast("timestamp")).withWatermark("event_time", lateness)
    key = F.coalesce("doc_hash", F.concat_ws("|", F.lit("none"), "doc_id", F.col("chunk_index").cast("string")))
    return marked.withColumn("key", key).dropDuplicatesWithinWatermark(["key"]).drop("key")


def log_by_hour(stream: DataFrame, lateness: str = "26 hours") -> DataFrame:
    """Queries and mean latency by hour and mode; rows later than the lateness are dropped."""
    marked = stream.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", lateness)
    return marked.groupBy(F.window("event_time", "1 hour").alias("w"), "modo").agg(
        F.count(F.lit(1)).alias("consultas"), F.round(F.avg("latencia_ms"), 2).alias("latencia_media_ms")
    ).select(F.col("w.start").alias("hora"), "modo", "consultas", "latencia_media_ms")


def into_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to a Parquet table, then stop; run again for what came since."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
