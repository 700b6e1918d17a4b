"""Trajectories and their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.storage import shared_folder

SEQ = "sequence_id"


def _written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read again, so that a loop's plan stays short."""
    spark = df.sparkSession
    target = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def lbep(tracks: DataFrame) -> DataFrame:
    """label, begin, end and the parent of the earliest row of each trajectory. A5."""
    first = F.min(F.struct("t", "index", "parent_track"))
    return tracks.groupBy(SEQ, F.col("label_track").alias("label")).agg(F.min("t").alias("b"), F.max("t").alias("e"), first.alias("_f")).select(SEQ, "label", "b", "e", F.col("_f.parent_track").alias("parent"))


def degrees(links: DataFrame, most_targets: int = 2) -> DataFrame:
    """(sequence_id, index, side, n): nodes with more than one source, or more targets than allowed. G10."""
    into = links.groupBy(SEQ, F.col("dst").alias("index")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("side", F.lit("in"))
    out = links.groupBy(SEQ, F.col("src").alias("index")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_targets).withColumn("side", F.lit("out"))
    return into.union(out).select(SEQ, "index", "side", "n")


def trajectories(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(sequence_id, index, start, parent): each node's trajectory, named by its first node, and the parent trajectory.

    Links are a forest: at most one source for each node. A trajectory begins where there is no source, or where the
    source has several targets. Pointer doubling: every node points to its source inside the trajectory; each round
    it points to what that one points to, so the rounds are the logarithm of the longest trajectory. G11."""
    many = links.groupBy(SEQ, "src").agg(F.count(F.lit(1)).alias("_n"))
    source = links.join(many, [SEQ, "src"]).select(SEQ, F.col("dst").alias("index"), F.col("src").alias("source"), (F.col("_n") == 1).alias("_same"))
    base = nodes.select(SEQ, "index").join(source, [SEQ, "index"], "left")
    base = _written(base.select(SEQ, "index", "source", F.when(F.coalesce("_same", F.lit(False)), F.col("source")).otherwise(F.col("index")).alias("at")), "lineage")
    at = base.select(SEQ, "index", "at")
    while True:
        ahead = at.select(SEQ, F.col("index").alias("at"), F.col("at").alias("next"))
        stepped = _written(at.join(ahead, [SEQ, "at"]).select(SEQ, "index", "at", "next"), "lineage")
        at = stepped.select(SEQ, "index", F.col("next").alias("at"))
        if stepped.where("at != next").isEmpty():
            break
    heads = base.where("at = index").select(SEQ, F.col("index").alias("start"), "source")
    parent = heads.join(at.withColumnsRenamed({"index": "source", "at": "parent"}), [SEQ, "source"], "left").select(SEQ, "start", "parent")
    return at.withColumnRenamed("at", "start").join(parent, [SEQ, "start"]).select(SEQ, "index", "start", "parent")


def numbered_labels(tracks: DataFrame) -> DataFrame:
    """label_track 1..n in order of the first nodes, parent_track 0 where there is none. G11."""
    from trackweave.operators.numbering import numbered

    heads = numbered(tracks.where("index = start").select(SEQ, "start"), "label_track", "start")
    own = tracks.join(heads, [SEQ, "start"])
    return own.join(heads.withColumnsRenamed({"start": "parent", "label_track": "parent_track"}), [SEQ, "parent"], "left").select(SEQ, "index", "label_track", F.coalesce("parent_track", F.lit(0)).alias("parent_track"))


def assemble(nodes: DataFrame, labels: DataFrame, meta: DataFrame) -> DataFrame:
    """Nodes with their trajectory, and the trajectory's parent, 0 if unknown. J16."""
    given = nodes.join(labels.select(SEQ, "index", "label_track"), [SEQ, "index"]).join(meta.select(SEQ, "label_track", "parent_track"), [SEQ, "label_track"], "left")
    return given.withColumn("parent_track", F.coalesce("parent_track", F.lit(0))).withColumn("cell_source", F.lit("original"))


def relabel_pixels(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """Pixels by trajectory; labels without one become background. J17, C18. labels is (sequence_id, t, label, label_track)."""
    return pixels.join(labels.select(SEQ, "t", "label", "label_track"), [SEQ, "t", "label"], "left").withColumn("label", F.coalesce("label_track", F.lit(0))).drop("label_track")


def lineage_map(tracks: DataFrame) -> DataFrame:
    """Distinct (label, parent) with a real parent. P2."""
    return tracks.select(SEQ, F.col("label_track").alias("label"), F.col("parent_track").alias("parent")).where("parent is not null and parent > 0 and parent != label").distinct()


def clean(tracks: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Tracks for users: no bookkeeping, the predicted state, int ids. F29, P1."""
    given = tracks.drop("state", "label", "parent", "cell_source")
    if states is not None:
        given = given.join(states.select(SEQ, "index", "state"), [SEQ, "index"], "left")
    return given.withColumnsRenamed({"label_track": "label", "parent_track": "parent"}).withColumns({"label": F.col("label").cast("int"), "parent": F.coalesce("parent", F.lit(0)).cast("int")})


def combined_table(tracks: DataFrame, axes: int = 2) -> DataFrame:
    """label, t, centre and parent, as the combined CSV has them. K10."""
    return tracks.select(SEQ, F.col("label_track").alias("label"), "t", *(F.col(f"center_{i}").alias(("cz", "cy", "cx")[3 - axes + i]) for i in range(axes)), F.coalesce("parent_track", F.lit(0)).alias("parent"))


def position_before(tracks: DataFrame) -> DataFrame:
    """Each daughter's first row with the parent's position one frame earlier. J25."""
    first = tracks.groupBy(SEQ, "label_track").agg(F.min(F.struct("t", "index", "parent_track", "center_0", "center_1")).alias("x")).select(SEQ, "label_track", "x.*")
    parent = tracks.select(SEQ, F.col("label_track").alias("parent_track"), (F.col("t") + 1).alias("t"), F.col("center_0").alias("from_0"), F.col("center_1").alias("from_1"))
    return first.join(parent, [SEQ, "parent_track", "t"]).select(SEQ, "label_track", "parent_track", "t", "from_0", "from_1", "center_0", "center_1")


def states_table(node_preds: DataFrame, labels: DataFrame, klass: Column) -> DataFrame:
    """Predicted state of each tracked cell with its trajectory. K9."""
    return node_preds.select(SEQ, "index", klass.alias("state")).join(labels, [SEQ, "index"], "left").withColumn("label_source", F.lit("tracked"))


def spans(tracks: DataFrame) -> DataFrame:
    """First and last frame, frames and nodes, and the largest parent of each trajectory. A14."""
    return tracks.groupBy(SEQ, "label_track").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.sort_array(F.collect_set("t")).alias("frames"), F.sort_array(F.collect_set("index")).alias("nodes"), F.max("parent_track").alias("parent"))


def trailing(tracks: DataFrame, t: int, n: int) -> DataFrame:
    """Rows of the last n frames up to t. W7."""
    return tracks.where(F.col("t").between(t - n, t))
