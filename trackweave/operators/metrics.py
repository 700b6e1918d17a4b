"""Class counts, confusion matrices, class weights and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ = "sequence_id"


def class_counts(df: DataFrame, y: str, classes: int, by: list[str] | None = None) -> DataFrame:
    """Rows of each class 0..classes-1, zero included; labels outside are clipped, null counts as 0. A8."""
    by = by or []
    clipped = F.least(F.greatest(F.coalesce(F.col(y), F.lit(0)), F.lit(0)), F.lit(classes - 1)).cast("int")
    held = df.groupBy(*by, clipped.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    else:
        every = df.select(*by).distinct().withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    return every.join(held, [*by, "class"], "left").select(*by, "class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion(df: DataFrame, y: str, y_pred: str, by: list[str] | None = None) -> DataFrame:
    """Counts of (class, predicted class) with the shares of their row and of their column. A10."""
    by = by or []
    n = df.groupBy(*by, F.col(y).alias("y"), F.col(y_pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    row, column = Window.partitionBy(*by, "y"), Window.partitionBy(*by, "y_pred")
    return n.withColumns({"row_share": F.col("n") / F.sum("n").over(row), "column_share": F.col("n") / F.sum("n").over(column)})


def one_vs_rest(df: DataFrame, y: str, y_pred: str, classes: int, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn of each class. The pairs of classes are counted before they are spread over the classes. A9, A11."""
    by = by or []
    pairs = df.groupBy(*by, F.col(y).alias("_y"), F.col(y_pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    each = pairs.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    is_y, is_p = F.col("_y") == F.col("class"), F.col("_p") == F.col("class")
    total = lambda on: F.coalesce(F.sum(F.when(on, F.col("_n"))), F.lit(0)).cast("long")
    return each.groupBy(*by, "class").agg(total(is_y & is_p).alias("tp"), total(~is_y & is_p).alias("fp"), total(is_y & ~is_p).alias("fn"), total(~is_y & ~is_p).alias("tn"))


def f1_scores(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro and micro F1 from one_vs_rest; a class without any rows counts 0 in the macro mean. A10."""
    by = by or []
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    micro = 2 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))
    return counts.groupBy(*by).agg(F.avg(f1).alias("macro_f1"), micro.alias("micro_f1"))


def class_weights(counts: DataFrame, method: str = "sqrt", beta: float = 0.999) -> DataFrame:
    """A weight for each class, 0 for an empty one; the weights add up to the number of classes that occur.

    sqrt: 1 / (sqrt(share) + 1e-6); effective: (1 - beta) / (1 - beta^n + 1e-6). A22."""
    w = Window.partitionBy(F.lit(1))  # one row for each class
    share = F.col("n") / F.sum("n").over(w)
    raw = 1 / (F.sqrt(share) + 1e-6) if method == "sqrt" else (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n")) + 1e-6)
    given = counts.withColumn("_raw", F.when(F.col("n") > 0, raw).otherwise(0.0))
    present = F.count_if(F.col("n") > 0).over(w)
    return given.withColumn("weight", F.col("_raw") * present / F.sum("_raw").over(w)).drop("_raw")


def cross_entropy(p_true: Column) -> Column:
    """-ln of the true class's probability, bounded away from zero. N13."""
    return -F.log(F.greatest(p_true, F.lit(1e-12)))


def focal(p_true: Column, gamma: float, weight: Column | None = None) -> Column:
    """(1 - p)^gamma times the cross entropy, times the class weight; gamma 0 is the cross entropy. N12."""
    loss = F.pow(1 - p_true, F.lit(float(gamma))) * cross_entropy(p_true)
    return loss if weight is None else loss * weight


def reduce_loss(df: DataFrame, loss: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """Mean and sum of the losses, and their sum over the number of positive rows. N12."""
    return df.groupBy(*(by or [])).agg(F.avg(loss).alias("mean"), F.sum(loss).alias("sum"), (F.sum(loss) / F.greatest(F.count_if(positive), F.lit(1))).alias("weighted_mean"))


def sampling_weights(sizes: DataFrame, alpha: float, floor: float) -> DataFrame:
    """What share of the samples each sequence gets, and each of its windows: size^alpha, normalised, raised to the
    floor, normalised again; sizes is (sequence_id, size, length). A21."""
    w = Window.partitionBy(F.lit(1))  # one row for each sequence
    mass = F.pow(F.col("size").cast("double"), F.lit(float(alpha)))
    first = sizes.withColumn("_m", mass).withColumn("_m", F.col("_m") / F.sum("_m").over(w))
    raised = first.withColumn("_m", F.greatest(F.col("_m"), F.lit(float(floor))))
    return raised.withColumn("mass", F.col("_m") / F.sum("_m").over(w)).withColumn("weight", F.col("mass") / F.col("length")).drop("_m")


def feature_means(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean of every feature over all rows. A12, K14."""
    return df.groupBy(*(by or [])).agg(*(F.avg(c).alias(f"mean_{c}") for c in columns))


def phase_summary(nodes: DataFrame, edges: DataFrame, phases: DataFrame) -> DataFrame:
    """Sequences, frames, nodes and edges of each phase; phases is (sequence_id, phase). A27."""
    by_sequence = nodes.groupBy(SEQ).agg(F.countDistinct("t").alias("frames"), F.count(F.lit(1)).alias("nodes"))
    links = edges.groupBy(SEQ).agg(F.count(F.lit(1)).alias("edges"))
    joined = phases.join(by_sequence, SEQ, "left").join(links, SEQ, "left")
    return joined.groupBy("phase").agg(F.count(F.lit(1)).alias("sequences"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("frames", "nodes", "edges")))


def cache_status(files: DataFrame) -> DataFrame:
    """What became of a cache from its times before and after (null: no file). A26."""
    b, a = F.col("before"), F.col("after")
    status = F.when(b.isNull() & a.isNull(), "absent").when(b.isNull(), "created").when(a.isNull(), "removed").when(b == a, "used").otherwise("invalidated")
    return files.withColumn("status", status)
