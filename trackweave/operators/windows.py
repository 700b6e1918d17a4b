"""Windows and patches: the frame pairs that belong together, and the subgraphs made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEQ = "sequence_id"


def frame_pairs(frames: DataFrame, dts: list[int], connectivity: str = "star") -> DataFrame:
    """(sequence_id, window_t, t, dist_temp): star pairs (t, t + s); sequential the neighbours in t, t + s1, t + s2, ...;
    dense all pairs of these. J2."""
    steps = [0, *sorted(dts)]
    if connectivity == "star":
        pairs = [(0, s) for s in steps[1:]]
    elif connectivity == "sequential":
        pairs = [(a, b - a) for a, b in zip(steps, steps[1:], strict=False)]
    elif connectivity == "dense":
        pairs = [(a, b - a) for i, a in enumerate(steps) for b in steps[i + 1 :]]
    else:
        raise ValueError(f"unknown connectivity {connectivity!r}")
    each = F.array(*(F.struct(F.lit(a).alias("at"), F.lit(s).alias("step")) for a, s in pairs))
    return frames.select(SEQ, F.col("t").alias("window_t"), F.explode(each).alias("p")).select(SEQ, "window_t", (F.col("window_t") + F.col("p.at")).alias("t"), F.col("p.step").alias("dist_temp"))


def boundary_pairs(pairs: DataFrame, bounds: DataFrame, bidirectional: bool = True) -> DataFrame:
    """Pairs past an end of the sequence are moved by their stride, if links go both ways; what is still outside, and
    stride 0, goes. bounds is (sequence_id, n_frames). J3."""
    given = pairs.join(bounds, SEQ).withColumn("_to", F.col("t") + F.col("dist_temp")).where("dist_temp != 0")
    if bidirectional:
        n = F.abs("dist_temp")
        shift = F.when((F.col("t") >= F.col("n_frames")) | (F.col("_to") >= F.col("n_frames")), -n).when((F.col("t") < 0) | (F.col("_to") < 0), n).otherwise(0)
        given = given.withColumn("_s", shift).withColumns({"t": F.col("t") + F.col("_s"), "_to": F.col("_to") + F.col("_s")})
    return given.where("t >= 0 and _to >= 0 and t < n_frames and _to < n_frames").select(*pairs.columns)


def anchors(dts: list[int], view: float | None) -> list[int]:
    """Offsets of a window's anchor frames: ceil(view * steps - 0.5) on each side, a least stride apart. J4."""
    import math

    half = 0 if view is None else max(0, math.ceil(view * len(dts) - 0.5))
    return [k * min(dts) for k in range(-half, half + 1)]


def window_pairs(frames: DataFrame, dts: list[int], view: float | None = None, bidirectional: bool = True) -> DataFrame:
    """Distinct (sequence_id, window_t, t, dist_temp) of all windows: every anchor with every stride, both ways. J5."""
    steps = [*dts, *(-s for s in dts)] if bidirectional else list(dts)
    at = F.explode(F.array(*map(F.lit, anchors(dts, view)))).alias("_a")
    given = frames.select(SEQ, F.col("t").alias("window_t"), at).withColumn("dist_temp", F.explode(F.array(*map(F.lit, steps))))
    return given.select(SEQ, "window_t", (F.col("window_t") + F.col("_a")).alias("t"), "dist_temp").distinct()


def edges_of_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links of the given frame pairs, once for each window. F18, G5."""
    return edges.join(pairs, [SEQ, "t", "dist_temp"])


def within_radius(edges: DataFrame, radius: float) -> DataFrame:
    """Links of a wider store that a smaller radius leaves; the filter reaches the scan. F19."""
    return edges.where(F.col("dist_spat") <= radius)


def flag_unannotated(edges: DataFrame, missing: DataFrame) -> DataFrame:
    """drop: whether an end is unannotated; missing is (sequence_id, index). F20."""
    gone = missing.select(SEQ, "index").distinct().withColumn("_m", F.lit(True))
    side = lambda end: gone.select(SEQ, F.col("index").alias(end), F.col("_m").alias(f"_{end}"))
    given = edges.join(side("src"), [SEQ, "src"], "left").join(side("dst"), [SEQ, "dst"], "left")
    return given.withColumn("drop", F.coalesce("_src", F.lit(False)) | F.coalesce("_dst", F.lit(False))).drop("_src", "_dst")


def usable_windows(edges: DataFrame, least: int = 1) -> DataFrame:
    """(sequence_id, window_t, usable, empty): links that may be used, and whether they are too few. F20, G15."""
    n = edges.groupBy(SEQ, "window_t").agg(F.count_if(~F.col("drop")).alias("usable"))
    return n.withColumn("empty", F.col("usable") < least)


def local_ids(edges: DataFrame, by: str = "window_t") -> DataFrame:
    """(sequence_id, by, index, local): nodes of each window numbered 0..n-1 by index. J11."""
    ends = edges.select(SEQ, by, F.explode(F.array("src", "dst")).alias("index")).distinct()
    return ends.withColumn("local", F.row_number().over(Window.partitionBy(SEQ, by).orderBy("index")) - 1)


def remap(edges: DataFrame, mapping: DataFrame, by: str = "window_t") -> DataFrame:
    """Links by window-local ids; links to nodes that the mapping lacks go. J11."""
    side = lambda end: mapping.select(SEQ, by, F.col("index").alias(end), F.col("local").alias(f"{end}_local"))
    return edges.join(side("src"), [SEQ, by, "src"]).join(side("dst"), [SEQ, by, "dst"])


def pair_counts(edges: DataFrame) -> DataFrame:
    """Links of each (t, dist_temp) and where they begin in the table sorted by these. A6."""
    n = edges.groupBy(SEQ, "t", "dist_temp").agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(SEQ).orderBy("t", "dist_temp"))
    return n.withColumn("offset", up_to - F.col("n"))


def patches(nodes: DataFrame, size: float, overlap: float, centre: list[str]) -> DataFrame:
    """(sequence_id, t, low_i, high_i): boxes over each frame's nodes, a step of size * (1 - overlap) apart, the last
    flush with the end; boxes without nodes go. G4."""
    step = max(1, int(size * (1 - overlap)))
    ends = nodes.groupBy(SEQ, "t").agg(*(f(c).alias(f"{k}_{i}") for i, c in enumerate(centre) for k, f in (("min", F.min), ("max", F.max))))
    for i in range(len(centre)):
        low, high = F.floor(F.col(f"min_{i}")).cast("int"), F.ceil(F.col(f"max_{i}")).cast("int")
        last = F.greatest(low, high - int(size))
        starts = F.array_distinct(F.concat(F.sequence(low, last, F.lit(step)), F.array(last)))
        ends = ends.withColumn(f"low_{i}", F.explode(starts)).withColumn(f"high_{i}", F.col(f"low_{i}") + int(size))
    boxes = ends.select(SEQ, "t", *(f"{k}_{i}" for i in range(len(centre)) for k in ("low", "high")))
    return _inside(nodes.select(SEQ, "t", *centre), boxes, centre, size).select(*boxes.columns).distinct()


def _inside(points: DataFrame, boxes: DataFrame, centre: list[str], size: float) -> DataFrame:
    """Points with the (closed) boxes of their frame that they lie in, by cells of a grid that a box touches few of."""
    cells = [f"_cell_{i}" for i in range(len(centre))]
    cell = lambda c: F.floor(F.col(c) / size)
    for i, name in enumerate(cells):
        boxes = boxes.withColumn(name, F.explode(F.sequence(cell(f"low_{i}"), cell(f"high_{i}"))))
    met = boxes.join(points.withColumns({name: cell(c) for name, c in zip(cells, centre, strict=True)}), [SEQ, "t", *cells]).drop(*cells)
    for i, c in enumerate(centre):
        met = met.where(F.col(c).between(F.col(f"low_{i}"), F.col(f"high_{i}")))
    return met


def patch_edges(edges: DataFrame, boxes: DataFrame, centre: list[str], size: float) -> DataFrame:
    """Links of a box's frame with either end in the (closed) box of the given side; the links carry the ends'
    positions, and each is given once for a box: by its source, or by its target if the source is outside. F21."""
    ends = edges.withColumn("_end", F.explode(F.array(F.lit("src"), F.lit("dst"))))
    at = [f"_at_{i}" for i in range(len(centre))]
    ends = ends.withColumns({a: F.when(F.col("_end") == "src", F.col(f"{c}_src")).otherwise(F.col(f"{c}_dst")) for a, c in zip(at, centre, strict=True)})
    first = F.lit(True)
    for i, c in enumerate(centre):
        first &= F.col(f"{c}_src").between(F.col(f"low_{i}"), F.col(f"high_{i}"))
    return _inside(ends, boxes, at, size).where((F.col("_end") == "src") | ~F.coalesce(first, F.lit(False))).drop("_end", *at)


def boxes_around(points: DataFrame, boxes: DataFrame, centre: list[str], size: float, name: str, frame: str = "t") -> DataFrame:
    """Points with an array of the (closed) boxes of ``frame`` that they lie in, as structs; empty if in none."""
    cells = [f"_cell_{i}" for i in range(len(centre))]
    cell = lambda c: F.floor(F.col(c) / size)
    box = F.struct(*(c for c in boxes.columns if c not in (SEQ, "t")))
    for i, c in enumerate(cells):
        boxes = boxes.withColumn(c, F.explode(F.sequence(cell(f"low_{i}"), cell(f"high_{i}"))))
    there = boxes.groupBy(SEQ, F.col("t").alias(frame), *cells).agg(F.collect_list(box).alias(name))
    met = points.withColumns({n: cell(c) for n, c in zip(cells, centre, strict=True)}).join(there, [SEQ, frame, *cells], "left").drop(*cells)

    def holds(x):
        inside = F.lit(True)
        for i, c in enumerate(centre):
            inside &= F.col(c).between(x[f"low_{i}"], x[f"high_{i}"])
        return inside

    return met.withColumn(name, F.coalesce(F.filter(name, holds), F.array().cast(there.schema[name].dataType)))


def near_pairs(df: DataFrame, key: str, most: int, index: str = "index") -> DataFrame:
    """(sequence_id, key, src, dst): rows of one key whose indices are 1 to ``most`` apart, the smaller first.

    Rows meet by stretches of ``most`` indices, each with its own and the one before, so a hot key costs what it finds."""
    at = F.floor(F.col(index) / most)
    left = df.select(SEQ, key, F.col(index).alias("src"), at.alias("_at"))
    right = df.select(SEQ, key, F.col(index).alias("dst"), F.explode(F.array(at, at - 1)).alias("_at"))
    return left.join(right, [SEQ, key, "_at"]).where(F.col("dst").between(F.col("src") + 1, F.col("src") + most)).drop("_at")


def every_nth(df: DataFrame, n: int) -> DataFrame:
    """Every n-th row by its dense position. L7: the documented stride, not a renumbered one."""
    return df.where(F.pmod("position", F.lit(n)) == 0)


def hash_sample(df: DataFrame, fraction: float, seed: int, *key: str) -> DataFrame:
    """Dropout that reruns repeat: rows whose hash is below the fraction. L6."""
    return df.where(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))


def capped(df: DataFrame, most: int, seed: int, *key: str) -> DataFrame:
    """At most so many rows of each sequence, those with the least hashes. L6. Ranks have a limit, so each task cuts its
    rows to it before the shuffle."""
    w = Window.partitionBy(SEQ).orderBy(F.xxhash64(*key, F.lit(seed)), *key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


#: Steps of a draw's uniform number: 52 bits of hash.
DRAW = 1 << 52


def weighted_draws(weights: DataFrame, n: int, seed: int) -> DataFrame:
    """(draw, sequence_id): n draws with replacement by mass. L8.

    A draw's number comes from the hash of draw and seed, so reruns agree on any cluster. Each sequence stands in the
    cells of a grid of as many cells as there are sequences that its part of the cumulated mass touches; a draw looks
    into its own cell only."""
    order = Window.orderBy(SEQ)  # one row for each sequence
    total = F.sum("mass").over(Window.partitionBy(F.lit(0)))
    upper = F.sum("mass").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ladder = weights.where("mass > 0").select(SEQ, ((upper - F.col("mass")) / total).alias("_low"), (upper / total).alias("_high"), F.lead(SEQ).over(order).isNull().alias("_last"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("_cells"))
    cell = lambda u: F.least(F.floor(u * F.col("_cells")), F.col("_cells") - 1)
    ladder = ladder.withColumn("_cell", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high")))))
    cells = weights.where("mass > 0").agg(F.count(F.lit(1)).alias("_cells"))
    draws = weights.sparkSession.range(n).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(DRAW)) / DRAW).alias("_u"))
    draws = draws.withColumn("_cells", F.lit(cells.first()[0])).withColumn("_cell", cell(F.col("_u"))).drop("_cells")
    met = draws.join(ladder, "_cell")
    return met.where((F.col("_u") >= F.col("_low")) & ((F.col("_u") < F.col("_high")) | F.col("_last"))).select("draw", SEQ)
