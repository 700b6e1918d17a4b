"""Predictions of candidate links: scores p0..pk on (sequence_id, src, dst), with src < dst meaning forward in time."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ = "sequence_id"


def score_columns(df: DataFrame) -> list[str]:
    """p0, p1, ... in order of their number."""
    return sorted((c for c in df.columns if re.fullmatch(r"p\d+", c)), key=lambda c: int(c[1:]))


def from_arrays(df: DataFrame, ends: list[str], scores: str, n: int, carry: list[str] | None = None) -> DataFrame:
    """Scores held as an array become columns p0..p(n-1). F35."""
    return df.select(SEQ, *ends, *(carry or []), *(F.element_at(scores, k + 1).alias(f"p{k}") for k in range(n)))


def average_duplicates(df: DataFrame, keys: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """One row for each key: mean scores, the (constant) class and the least loader index. A1, N15."""
    held = [c for c in ("y", "dataloader_idx") if c in df.columns]
    return df.groupBy(SEQ, *keys).agg(*(F.avg(c).alias(c) for c in score_columns(df)), *(F.min(c).alias(c) for c in held))


def reversed_ends(df: DataFrame) -> DataFrame:
    swap = {"src": "dst", "dst": "src"}
    return df.select(*(F.col(swap.get(c, c)).alias(c) for c in df.columns))


def merge_directions(df: DataFrame) -> DataFrame:
    """Forward links joined with the reversed backward ones, scores averaged; links without a partner are lost.

    If a sequence has links in one direction only, they pass (backward ones reversed). J13."""
    scores = score_columns(df)
    forward, backward = df.where("src < dst"), reversed_ends(df.where("src > dst"))
    sides = df.groupBy(SEQ).agg(F.count_if(F.col("src") < F.col("dst")).alias("_f"), F.count_if(F.col("src") > F.col("dst")).alias("_b"))
    reverse = backward.select(SEQ, "src", "dst", *(F.col(c).alias(f"_{c}") for c in scores))
    both = forward.join(reverse, [SEQ, "src", "dst"]).select(*[((F.col(c) + F.col(f"_{c}")) / 2).alias(c) if c in scores else F.col(c) for c in df.columns])
    alone = forward.unionByName(backward.select(*df.columns)).join(sides.where("_f = 0 or _b = 0").select(SEQ), SEQ, "left_semi")
    return both.unionByName(alone.select(*df.columns))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def with_sigmoid(df: DataFrame) -> DataFrame:
    """Each score on its own. F22."""
    return df.withColumns({c: sigmoid(F.col(c)) for c in score_columns(df)})


def with_softmax(df: DataFrame) -> DataFrame:
    """Scores of a row add up to one; shifted by their largest, so that nothing overflows. F23."""
    p = score_columns(df)
    top = F.greatest(*p) if len(p) > 1 else F.col(p[0])
    lifted = df.withColumns({f"_{c}": F.exp(F.col(c) - top) for c in p})
    total = sum((F.col(f"_{c}") for c in p), F.lit(0.0))
    return lifted.select(*[(F.col(f"_{c}") / total).alias(c) if c in p else F.col(c) for c in df.columns])


def expand_binary(df: DataFrame) -> DataFrame:
    """One score a becomes (1 - a, 0, a); a is squashed unless all of a sequence's scores are in [0, 1] already. F24."""
    whole = df.groupBy(SEQ).agg((F.min("p0") >= 0).alias("_low"), (F.max("p0") <= 1).alias("_high"))
    rest = [c for c in df.columns if c != "p0"]
    given = df.join(whole, SEQ).withColumn("_a", F.when(F.col("_low") & F.col("_high"), F.col("p0")).otherwise(sigmoid(F.col("p0"))))
    return given.select(*rest, (1 - F.col("_a")).alias("p0"), F.lit(0.0).alias("p1"), F.col("_a").alias("p2"))


def drop_nan(df: DataFrame) -> DataFrame:
    """Rows whose first score is a number. F25."""
    return df.where(~F.isnan("p0"))


def sanitise(df: DataFrame) -> DataFrame:
    """Duplicates averaged, directions merged and, for a single score, three classes made of it. F36."""
    merged = merge_directions(average_duplicates(df))
    return expand_binary(merged) if len(score_columns(df)) == 1 else merged


def candidates(df: DataFrame, kind: str, threshold: float, ignore_negative: bool = True) -> DataFrame:
    """Links whose class 1 (correspondence) or 2 (division) is above the threshold and the largest.

    p0 takes part in the comparison unless ignore_negative; a tie of p1 and p2 is in both sets. F26."""
    own = F.col({"correspondence": "p1", "division": "p2"}[kind])
    rivals = ["p1", "p2"] if ignore_negative else ["p0", "p1", "p2"]
    return df.where((own > threshold) & (own == F.greatest(*rivals)))


def argmax_class(df: DataFrame) -> Column:
    """The number of the largest score, the first on ties. F27, F38."""
    p = score_columns(df)
    if len(p) == 1:
        return (F.col(p[0]) > 0).cast("int")
    scores = F.array(*p)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def with_true_class(df: DataFrame, y: str = "y") -> DataFrame:
    """The predicted class and the probability that the row's own class has. F28."""
    p = score_columns(df)
    soft = with_softmax(df) if len(p) > 1 else with_sigmoid(df)
    scores = F.array(*p) if len(p) > 1 else F.array(1 - F.col(p[0]), F.col(p[0]))
    predicted = (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
    return soft.withColumns({"p_true": F.try_element_at(scores, F.col(y) + 1), "y_pred": predicted})


def add_frames(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """t of the source and td, the frames from source to target. J12."""
    at = nodes.select(SEQ, F.col("index").alias("src"), F.col("t").alias("t"))
    to = nodes.select(SEQ, F.col("index").alias("dst"), F.col("t").alias("_to"))
    return df.join(at, [SEQ, "src"]).join(to, [SEQ, "dst"]).withColumn("td", F.col("_to") - F.col("t")).drop("_to")


def with_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels of the links, null where there is none. J20."""
    return df.join(labels, [SEQ, "src", "dst"], "left")


def specific_score(df: DataFrame) -> DataFrame:
    """(sequence_id, score_column): p2 if p1 is zero all over the sequence, else p1. F34."""
    return df.groupBy(SEQ).agg(F.when(F.max("p1") == 0, "p2").otherwise("p1").alias("score_column"))


def extreme_samples(df: DataFrame, worst: int, best: int, loss: str = "loss") -> DataFrame:
    """The worst and best rows of each class by loss; mirrored links and repeated sources count once.

    A class with no more than worst + best rows left keeps all. Ties by src, then dst. L3."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    mirror = Window.partitionBy(SEQ, "y", a, b).orderBy(F.desc(loss), "src", "dst")
    source = Window.partitionBy(SEQ, "y", "src").orderBy(F.desc(loss), "src", "dst")
    once = df.withColumn("_m", F.row_number().over(mirror)).where("_m = 1").withColumn("_s", F.row_number().over(source)).where("_s = 1")
    by_class = Window.partitionBy(SEQ, "y")
    down, up = by_class.orderBy(F.desc(loss), "src", "dst"), by_class.orderBy(loss, F.desc("src"), F.desc("dst"))
    ranked = once.withColumns({"_worst": F.row_number().over(down), "_best": F.row_number().over(up)})
    return ranked.where((F.col("_worst") <= worst) | (F.col("_best") <= best)).drop("_m", "_s", "_worst", "_best")


def remap_to_nodes(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Window-local ends back to node numbers; mapping is (sequence_id, window, local, index). F37."""
    src = mapping.select(SEQ, "window", F.col("local").alias("src"), F.col("index").alias("_src"))
    dst = mapping.select(SEQ, "window", F.col("local").alias("dst"), F.col("index").alias("_dst"))
    return df.join(src, [SEQ, "window", "src"]).join(dst, [SEQ, "window", "dst"]).drop("src", "dst").withColumnsRenamed({"_src": "src", "_dst": "dst"})
