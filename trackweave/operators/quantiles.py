"""Exact quantiles without a sort and without a buffer of all values: ranges that hold a rank are narrowed by histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.operators.lineage import _written

#: Bins of a histogram.
BINS = 4096


def quantiles(df: DataFrame, value: str, parts: list[float], keys: list[str] | None = None) -> DataFrame:
    """The ``keys`` with n (their values) and q, an array with the quantile of each of ``parts``, interpolated linearly
    between the two values around rank (n - 1) * part.

    Each wanted rank has a range of values. A round counts the values of all ranges in bins, takes for each rank the
    bin in which it lies, and goes on with the least and largest value of that bin, until they are equal. After the first
    round few values are left; what comes together are bins. Null and NaN count as absent; keys without values have
    no row; null keys are keys."""
    keys = list(keys or [])
    own = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    names = [f"_k{i}" for i in range(len(keys))]
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in names]
    ends = own.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0")
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.lit(float(p)).alias("p")) for i, p in enumerate(parts))))
    wanted = ends.withColumn("_at", at).withColumn("_place", (F.col("_n") - 1) * F.col("_at.p"))
    two = F.explode(F.array(F.floor("_place").cast("long"), F.ceil("_place").cast("long")))
    wanted = _written(wanted.withColumn("_rank", two).select(*names, "_n", "_rank", "_lo", "_hi").distinct().withColumn("_rest", F.col("_rank")), "quantile-ranks")
    done = wanted.where("_lo = _hi").select(*names, "_rank", F.col("_lo").alias("_q"))
    open_, values = wanted.where("_lo < _hi"), own
    while not open_.isEmpty():
        ranges = open_.select(*names, "_lo", "_hi").distinct()
        a, b = values.alias("a"), ranges.alias("b")
        inside = a.join(b, [*[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in names], F.col("a._v") >= F.col("b._lo"), F.col("a._v") <= F.col("b._hi")]) if names else a.join(b, (F.col("a._v") >= F.col("b._lo")) & (F.col("a._v") <= F.col("b._hi")))
        # By halves where the difference of two doubles exceeds all doubles.
        v, lo, hi = F.col("a._v"), F.col("b._lo"), F.col("b._hi")
        part = F.when(hi - lo < float("inf"), (v - lo) / (hi - lo)).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
        bin = F.least(F.floor(part * BINS), F.lit(BINS - 1)).alias("_bin")
        binned = inside.select(*(F.col(f"a.{k}") for k in names), F.col("b._lo"), F.col("b._hi"), F.col("a._v"), bin)
        held = binned.groupBy(*names, "_lo", "_hi", "_bin").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        upto = F.sum("_c").over(Window.partitionBy(*names, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        held = _written(held.withColumn("_upto", upto), "quantile-bins")
        on = same(open_, held) + [open_["_lo"] == held["_lo"], open_["_hi"] == held["_hi"], open_["_rest"] < held["_upto"], open_["_rest"] >= held["_upto"] - held["_c"]]
        step = open_.join(held, on).select(*(open_[k] for k in names), "_n", "_rank", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), (F.col("_rest") - F.col("_upto") + F.col("_c")).alias("_rest"))
        step = _written(step, "quantile-ranks")
        done = done.union(step.where("_lo = _hi").select(*names, "_rank", F.col("_lo").alias("_q")))
        open_ = step.where("_lo < _hi")
    found = _written(done, "quantile-values")
    every = ends.withColumn("_at", at).select(*names, "_n", "_at.part", ((F.col("_n") - 1) * F.col("_at.p")).alias("_place"))
    low, high = (found.withColumnRenamed("_q", q).withColumnRenamed("_rank", r) for q, r in (("_a", "_ra"), ("_b", "_rb")))
    every = every.join(low, same(every, low) + [F.floor("_place") == F.col("_ra")]).select(*(every[k] for k in names), "_n", "part", "_place", "_a")
    every = every.join(high, same(every, high) + [F.ceil("_place") == F.col("_rb")]).select(*(every[k] for k in names), "_n", "part", "_place", "_a", "_b")
    each = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_place") - F.floor("_place"))
    out = every.groupBy(*names, "_n").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(each).alias("q")))), lambda x: x["q"]).alias("q"))
    return out.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), F.col("_n").alias("n"), "q")
