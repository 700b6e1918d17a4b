"""Numbers within a sequence without gathering the sequence: range partitions count themselves, offsets do the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.operators.lineage import _written

SEQ = "sequence_id"


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` with ``name``, 1..n in each sequence by a total order of its rows.

    Rows are dealt to the session's number of range partitions by sequence and order, so a sequence that holds most
    rows is spread over most tasks; what is gathered of a sequence are the counts of its partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_o{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)}
    dealt = df.withColumns(keys).repartitionByRange(n, SEQ, *keys).withColumn("_part", F.spark_partition_id())
    dealt = _written(dealt, "numbered")
    before = Window.partitionBy(SEQ).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(SEQ, "_part").agg(F.count(F.lit(1)).alias("_n")).select(SEQ, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(SEQ, "_part").orderBy(*keys))
    return dealt.withColumn(name, within).join(counts, [SEQ, "_part"]).withColumn(name, (F.col(name) + F.col("_offset")).cast("long")).drop("_part", "_offset", *keys)
