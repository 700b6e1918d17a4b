"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.storage import shared_folder

#: White space of the corpus contracts: space and bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir."""
    return shared_folder(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/trackweave-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 16, by: Column | None = None) -> DataFrame:
    """Equi-join in which a hot key of ``big`` is dealt over ``salts`` tasks.

    ``small`` has at most one row for each key, so copying it ``salts`` times multiplies it by a constant only.
    ``by`` is what spreads the rows of ``big`` that share a key; a hash of all its columns by default.
    Key columns must not be null.
    """
    spread = F.pmod(F.xxhash64(*(big.columns if by is None else [by])), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", spread)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def spark_parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which a cluster sizes to its data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
