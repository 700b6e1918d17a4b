"""Lineage text files, states tables and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ = "sequence_id"
LINEAGE = T.StructType([T.StructField(c, T.IntegerType()) for c in ("label", "b", "e", "parent")])
STATES = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("label", "t", "state", "parent")), T.StructField(SEQ, T.StringType())])


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    """label, first frame, last frame, parent; separated by spaces, no header. S8."""
    return spark.read.schema(LINEAGE).option("sep", " ").csv(path)


def write_lineage(lbep: DataFrame, path: str) -> None:
    """One file in order of begin and label. The table has a row for each trajectory of one sequence. K6."""
    lbep.select("label", "b", "e", "parent").orderBy("b", "label").coalesce(1).write.option("sep", " ").csv(path)


def read_states(spark: SparkSession, path: str, sequence_id: str | int) -> DataFrame:
    """The cells of a sequence, states from 0; ids are compared as numbers, else as text. S9."""
    return one_sequence(spark.read.schema(STATES).option("header", True).csv(path), sequence_id)


def one_sequence(states: DataFrame, sequence_id: str | int) -> DataFrame:
    wanted = str(sequence_id)
    number = F.expr(f"try_cast({SEQ} as bigint)")
    same = F.coalesce(number == int(wanted), F.lit(False)) if wanted.lstrip("-").isdigit() else F.lit(False)
    return states.where(same | (F.col(SEQ) == wanted)).withColumn("state", F.col("state") - 1)


def states_to_lineage(states: DataFrame) -> DataFrame:
    """label, first frame, last frame and the parent of the earliest row. S10."""
    return states.groupBy("label").agg(F.min("t").alias("b"), F.max("t").alias("e"), F.min(F.struct("t", "parent")).alias("x")).select("label", "b", "e", F.col("x.parent").alias("parent"))


def splits_table(spark: SparkSession, splits: dict[int, dict[str, list[str]]]) -> DataFrame:
    """(fold, phase, sequence_id) of a splits mapping."""
    rows = [(fold, phase, s) for fold, phases in splits.items() for phase, ids in phases.items() for s in ids]
    return spark.createDataFrame(rows, f"fold int, phase string, {SEQ} string")


def sequences_of(splits: DataFrame, fold: int, phase: str | None = None) -> DataFrame:
    """The distinct sequences of a fold and phase, or of all its phases. S2, S23."""
    given = splits.where(F.col("fold") == fold)
    return (given if phase is None else given.where(F.col("phase") == phase)).select(SEQ).distinct()


def split_sequences(spark: SparkSession, splits: dict, fold: int, phase: str | None = None) -> list[str]:
    """As sequences_of, in order; an unknown fold or phase is an error. S2."""
    if fold not in splits:
        raise KeyError(f"no fold {fold}; there are {sorted(splits)}")
    if phase is not None and phase not in splits[fold]:
        raise KeyError(f"no phase {phase!r} in fold {fold}; there are {sorted(splits[fold])}")
    return sorted(r[0] for r in sequences_of(splits_table(spark, splits), fold, phase).collect())


def combined(*datasets: tuple[DataFrame, str, str]) -> DataFrame:
    """Sequences of several datasets, each (table, path, format), one under the other. S21."""
    out = None
    for k, (df, path, kind) in enumerate(datasets):
        own = df.select(F.lit(k).alias("dataset"), SEQ, F.lit(path).alias("path"), F.lit(kind).alias("format"))
        out = own if out is None else out.unionByName(own)
    return out


def dry_run(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Frames on each side of every sequence and whether they agree, from metadata alone. S22."""
    count = lambda df, name: df.groupBy(SEQ).agg(F.countDistinct("t").alias(name))
    both = count(images, "image_frames").join(count(masks, "mask_frames"), SEQ, "full")
    return both.select(SEQ, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("image_frames", "mask_frames"))).withColumn("agree", F.col("image_frames") == F.col("mask_frames"))
