"""Candidate links on disk, one partition for each stride: grown stride by stride, narrowed by filters."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators.edges import mirror

SEQ = "sequence_id"


@dataclass
class StoreMeta:
    """What a store was made with; strides holds all that were asked for, also those without links."""

    radius: float
    bidirectional: bool
    features: list[str] = field(default_factory=list)
    identity: str = ""
    strides: list[int] = field(default_factory=list)

    def serves(self, other: StoreMeta) -> bool:
        """Whether a request can be answered from here: at most this radius, these features and directions. G3, S20."""
        return self.radius >= other.radius and set(self.features) >= set(other.features) and self.identity == other.identity and (self.bidirectional or not other.bidirectional)


class EdgeStore:
    """A folder with links/ (partitioned by dt) and meta/ (one JSON row). K2, K3, S12, S13, G3, G14."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def meta(self) -> StoreMeta | None:
        from pyspark.errors import AnalysisException

        try:
            row = self.spark.read.text(f"{self.path}/meta").orderBy(F.length("value").desc()).first()
        except AnalysisException:
            return None
        return None if row is None else StoreMeta(**json.loads(row[0]))

    def write(self, links: DataFrame, meta: StoreMeta, anew: bool = False) -> None:
        """Replace the partitions of the links' strides; others stay, unless the store is made anew. Forward links only:
        the rest is their mirror."""
        forward = links.where("dist_temp > 0").withColumn("dt", F.abs("dist_temp"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = forward.repartition(parts, "dt", F.pmod(F.xxhash64("src"), F.lit(parts))).sortWithinPartitions("dt", "src", "dst")
        spread.write.mode("overwrite").option("partitionOverwriteMode", "static" if anew else "dynamic").partitionBy("dt").parquet(f"{self.path}/links")
        self.spark.createDataFrame([(json.dumps(asdict(meta)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")

    def strides(self) -> list[int]:
        """Strides that have links. S13."""
        return sorted(r[0] for r in self.spark.read.parquet(f"{self.path}/links").select("dt").distinct().collect())

    def scan(self, strides: list[int], radius: float, bidirectional: bool) -> DataFrame:
        """Links of the strides within the radius; both filters reach the files. S12, F19, G14."""
        found = self.spark.read.parquet(f"{self.path}/links").where(F.col("dt").isin(strides)).where(F.col("dist_spat") <= radius).drop("dt")
        return mirror(found) if bidirectional else found

    def get(self, want: StoreMeta, compute: Callable[[list[int], float], DataFrame]) -> DataFrame:
        """Links for a request: what the store has, what is missing computed and added; a store that can't serve it is
        made anew. compute(strides, radius) gives forward links. G3."""
        have = self.meta()
        if have is None or not have.serves(want):
            known = StoreMeta(want.radius, want.bidirectional, list(want.features), want.identity, [])
            missing = sorted(set(want.strides))
        else:
            known, missing = have, sorted(set(want.strides) - set(have.strides))
        if missing:
            known.strides = sorted({*known.strides, *missing})
            self.write(compute(missing, known.radius), known, anew=known is not have)
        return self.scan(want.strides, want.radius, want.bidirectional)
