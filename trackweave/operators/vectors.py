"""Message passing and pooling over vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQ = "sequence_id"


def pooled(tokens: DataFrame, weight: str = "weight", vector: str = "embedding") -> DataFrame:
    """Weighted mean of each node's token vectors. N5."""
    flat = tokens.select(SEQ, "index", F.col(weight).alias("_w"), F.posexplode(vector).alias("pos", "x"))
    mean = flat.groupBy(SEQ, "index", "pos").agg((F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("x"))
    return mean.groupBy(SEQ, "index").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("embedding"))


def concatenated(nodes: DataFrame, *columns: str) -> DataFrame:
    """Feature vectors one after the other. N7."""
    return nodes.withColumn("features", F.concat(*columns))


def messages(edges: DataFrame, nodes: DataFrame, how: str = "mean", vector: str = "embedding") -> DataFrame:
    """Each node's mean, max or min over its links of what they carry; zeros where no link arrives. N9.

    edges: (sequence_id, src, dst, message). What a hot node receives is added up before the shuffle."""
    f = {"mean": F.avg, "max": F.max, "min": F.min}[how]
    flat = edges.select(SEQ, F.col("dst").alias("index"), F.posexplode("message").alias("pos", "x"))
    got = flat.groupBy(SEQ, "index", "pos").agg(f("x").alias("x"))
    rows = got.groupBy(SEQ, "index").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("_m"))
    none = F.transform(F.col(vector), lambda x: F.lit(0.0))
    return nodes.join(rows, [SEQ, "index"], "left").withColumn("message", F.coalesce("_m", none)).drop("_m")


def time_aware_messages(edges: DataFrame, nodes: DataFrame, how: str = "mean", vector: str = "embedding") -> DataFrame:
    """What arrives from the past, what arrives from the future, and the node's own vector, in this order. N10."""
    past = messages(edges.where("src < dst"), nodes, how, vector).select(SEQ, "index", F.col("message").alias("_in"))
    future = messages(edges.where("src > dst"), nodes, how, vector).select(SEQ, "index", F.col("message").alias("_out"))
    own = nodes.join(past, [SEQ, "index"]).join(future, [SEQ, "index"])
    return own.withColumn("features", F.concat("_in", "_out", F.transform(vector, lambda x: x.cast("double")))).drop("_in", "_out")


def edge_inputs(edges: DataFrame, nodes: DataFrame, vector: str = "embedding") -> DataFrame:
    """Source vector, target vector and the link's own, one after the other. N8."""
    side = lambda end: nodes.select(SEQ, F.col("index").alias(end), F.transform(vector, lambda x: x.cast("double")).alias(f"_{end}"))
    given = edges.join(side("src"), [SEQ, "src"]).join(side("dst"), [SEQ, "dst"])
    return given.withColumn("features", F.concat("_src", "_dst", "message")).drop("_src", "_dst")


def linear(df: DataFrame, weights: list[list[float]], bias: list[float], column: str = "features", relu: bool = True) -> DataFrame:
    """A layer of a small network: bounded weights in the plan itself. N8, N11."""
    dot = lambda row, b: F.aggregate(F.zip_with(column, F.array(*map(F.lit, row)), lambda x, w: x * w), F.lit(float(b)), lambda s, x: s + x)
    out = [dot(row, b) for row, b in zip(weights, bias, strict=True)]
    return df.withColumn(column, F.array(*(F.greatest(F.lit(0.0), o) if relu else o for o in out)))


def network(nodes: DataFrame, edges: DataFrame, layers: list[tuple], vector: str = "embedding") -> DataFrame:
    """Rounds of time-aware messages, each followed by a layer (weights, bias); no layers: the nodes as they are. N11."""
    given = nodes
    for weights, bias in layers:
        carried = edges.drop("message").join(given.select(SEQ, F.col("index").alias("src"), F.transform(vector, lambda x: x.cast("double")).alias("message")), [SEQ, "src"])
        passed = linear(time_aware_messages(carried, given, "mean", vector), weights, bias)
        given = passed.withColumn(vector, F.col("features")).drop("features")
    return given
