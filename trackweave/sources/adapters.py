"""The engine's tables from the star-schema tables, in Spark; plans/ddb.py has the same in DuckDB SQL.

nodes: detections by hour; tracks: one row for each user and day; preds: candidate links with three logits; pixels:
labelled pixels by day; vectors: an embedding for each index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01 in seconds.
EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", "user_id", "event_type", "value", k.alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - EPOCH) / seconds).cast("int").alias("t"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, 3600)
    return e.select(
        F.col("event_type").alias("sequence_id"), F.col("event_id").alias("index"), "t", F.col("user_id").alias("label"), F.expr("user_id div 2").alias("parent"), F.col("value").alias("center_0"), F.col("k").alias("center_1"),
        F.col("value").alias("area"), F.col("value").alias("axis_major_length"), F.col("k").alias("axis_minor_length"), (F.col("k") / 16).alias("orientation"), (F.col("value") * F.col("k") / 100).alias("intensity_mean"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, 86400)
    first = e.groupBy("user_id", "t").agg(F.min(F.struct("ts", "event_id", "value", "k")).alias("x"))
    return first.select(F.lit("events").alias("sequence_id"), F.col("x.event_id").alias("index"), "t", F.col("user_id").alias("label_track"), F.expr("user_id div 2").alias("parent_track"), F.col("x.value").alias("center_0"), F.col("x.k").alias("center_1"), F.lit("original").alias("cell_source"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("sequence_id"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_tax") * 20 - 1).alias("p0"), (F.col("l_discount") * 40 - 2).alias("p1"),
        (F.col("l_quantity") / 25 - 1).alias("p2"), (F.col("l_linenumber") % 3).cast("int").alias("y"), (F.col("l_suppkey") % 4).cast("int").alias("dataloader_idx"),
    )


def dense_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """preds with ends folded onto 0..199, so that most links have both directions."""
    return preds(spark, sf_dir).withColumns({"src": F.col("src") % 200, "dst": F.col("dst") % 200}).where("src != dst")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, 86400)
    p = e.groupBy(F.col("event_type").alias("sequence_id"), "t", F.floor("value").cast("int").alias("y"), F.col("k").cast("int").alias("x"))
    return p.agg(F.min("user_id").alias("label"), F.max(F.col("value") - F.floor("value")).alias("intensity"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled candidate links with spatial and temporal distance, from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("sequence_id"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_linenumber") % 3).cast("int").alias("y"), (F.col("l_orderkey") % 48).cast("int").alias("t"),
        (F.col("l_suppkey") % 3 + 1).cast("int").alias("dist_temp"), F.col("l_quantity").alias("dist_spat"), F.col("l_discount").alias("overlap"), F.col("l_tax").alias("iou"),
        (F.col("l_discount") - F.col("l_tax")).alias("relative_size"), (F.col("l_tax") * 10).alias("intensity_mean_diff"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("embeddings").alias("sequence_id"), F.col("vec_id").alias("index"), "embedding", "label")
