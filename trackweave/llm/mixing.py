"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; the bucket where a source's budget runs out is refined by further bits of
the hash, down to single hash values; the final filter compares each row's hash with its source's threshold. Nothing
is sorted but the few thousand buckets of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import WORD, materialize, salted_join, spark_parts

#: Bits of the hash in all, and of each level of the histogram; what remains is compared value by value.
HASH_BITS, LEVEL_BITS = 52, (12, 12)


def word_count(text: Column) -> Column:
    """Words of a text as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(ident: Column, text: Column) -> Column:
    """Uniform in [0, 2**52), from the row's id and text alone, so that reruns and other engines agree."""
    whole = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit(""))))
    return F.conv(F.substring(whole, 1, HASH_BITS // 4), 16, 10).cast("long")


def salts(df: DataFrame) -> int:
    """Tasks for one source: a third of the session's, as one source may hold a third of all rows. What is copied to
    them is a row for each source."""
    return max(16, spark_parts(df) // 3)


def ranked_sources(slim: DataFrame) -> DataFrame:
    """(key, source_size, rank from 1 by code point, null last): ranks within range partitions plus their offsets."""
    n = spark_parts(slim)
    sizes = slim.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = materialize(sizes.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(offsets, "part").select("key", "source_size", (within + F.col("offset")).alias("rank"))


def water_level(sources: DataFrame, share: float, cap: int) -> float:
    """The level L for which targets min(cap * size, L * weight) add up to share of all sizes.

    Each round caps the sources whose part exceeds ``cap`` times their size and shares the excess among the others by
    weight, until none is above. A round is one aggregate of the source table; three numbers reach the driver.
    """
    level = None
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("source_size") * cap
        total, held, weight = sources.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("source_size") * cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))
        ).first()
        if not total or not weight:
            return level or 0.0
        raised = (total * share - held) / weight
        if level is not None and raised <= level:
            return level
        level = raised


def thresholds(slim: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, cut, n, m): rows of the source with a hash below cut, and m of the n that have it, add up to the budget as
    nearly as one more row allows."""
    left = HASH_BITS
    edge = budgets.select("key", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest"))
    for bits in (*LEVEL_BITS, left - sum(LEVEL_BITS)):
        last = left - bits == 0
        held = slim.select("key", "size", F.shiftright("h", left).alias("prefix"), F.shiftright("h", left - bits).alias("bucket"))
        sums = salted_join(held, edge, ["key", "prefix"], salts=salts(slim), by=F.col("bucket")).groupBy("key", "bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"))
        up_to = F.sum("size").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        run = sums.withColumn("after", up_to).withColumn("before", F.col("after") - F.col("size"))
        crossing = run.where((F.col("before") <= F.col("rest")) & (F.col("after") > F.col("rest")))
        rest = F.col("rest") - F.col("before")
        if last:  # a further row that crosses the budget is taken if that comes nearer to it
            m = F.ceil(rest * F.col("n") / F.col("size") - 0.5)
            return crossing.groupBy("key").agg(F.min(F.struct(F.col("bucket").alias("cut"), "n", m.alias("m"))).alias("x")).select("key", "x.*")
        edge = crossing.groupBy("key").agg(F.min(F.struct("bucket", rest.alias("rest"))).alias("x")).select("key", F.col("x.bucket").alias("prefix"), F.col("x.rest").alias("rest"))
        left -= bits


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with rank, from 1 in each key: by file parts, whose counts give the offsets."""
    parts = materialize(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "mix-tied")
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_n")).select("key", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("key", "_part").orderBy("_at"))
    return parts.withColumn("rank", within).join(offsets, ["key", "_part"]).withColumn("rank", F.col("rank") + F.col("_offset")).drop("_part", "_at", "_offset")


def mix(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = 3, carry: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` with how often the mix takes each of them.

    Returns ``ident``, the columns in ``carry``, and size, source_size, target, copies (int), taken (long).
    Sources by code point, null last, have the weights in turn. A source below its target is repeated whole as often
    as fits and once more up to a hash threshold; one above it is cut at a hash threshold.

    Null text: size 0, copies as its hash says. Null source: a source of its own, the last. Null id: the hash is the
    text's. Rows that repeat both id and text have one hash; where it is the threshold, as many of them are taken as
    come nearest to the target. Empty table: no rows. Other columns of ``docs`` play no part.
    """
    carry = [c for c in carry or [] if c != ident]
    base = docs.select(
        F.col(ident), *[F.col(c).alias(f"carry_{c}") for c in carry], F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("key"), word_count(F.col(text)).alias("size"), row_hash(F.col(ident), F.col(text)).alias("h"),
    )
    base = materialize(base, "mix-rows")
    slim = base.select("key", "source", "size", "h")
    turn = F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")
    sources = materialize(ranked_sources(slim).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)), "mix-weights")
    level = water_level(sources, share, cap)
    target = F.least(F.col("weight") * F.lit(float(level)), (F.col("source_size") * cap).cast("double"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = sources.select("key", "source_size", target.alias("target")).withColumn("whole", whole)
    plan = plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialize(plan, "mix-plan")
    cuts = thresholds(slim, plan.where("budget > 0").select("key", "budget"))
    plan = materialize(plan.join(cuts, "key", "left").drop("budget"), "mix-cuts")
    out = salted_join(base, plan, ["key"], "left", salts(slim), by=F.xxhash64("h", ident))
    if plan.where("n > 1").isEmpty():
        out = out.withColumn("rank", F.lit(1).cast("long"))
    else:  # rows that repeat stand at a threshold: they are numbered
        tied = F.coalesce((F.col("h") == F.col("cut")) & (F.col("n") > 1), F.lit(False))
        out = out.where(~tied).withColumn("rank", F.lit(1).cast("long")).unionByName(_numbered(out.where(tied)))
    more = (F.col("h") < F.col("cut")) | (F.col("h") == F.col("cut")) & (F.col("rank") <= F.col("m"))
    copies = (F.col("whole") + F.coalesce(more.cast("int"), F.lit(0))).cast("int")
    return out.select(ident, *[F.col(f"carry_{c}").alias(c) for c in carry], "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
