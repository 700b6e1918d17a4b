"""Node tables: one row for each detection, keyed by sequence_id and index."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.operators.quantiles import quantiles

SEQ, EPS = "sequence_id", 1e-6
#: Names of size features that normalisation scales by the initial length rather than the initial area.
LENGTHS = ("axis", "thickness", "septum_width")


def dense_index(df: DataFrame, *order: str) -> DataFrame:
    """index 0..n-1 in each sequence by the given total order; src < dst then means forward in time. W6."""
    from trackweave.operators.numbering import numbered

    keys = [F.col(c).alias(f"_by{k}") for k, c in enumerate(order)]
    out = numbered(df.select("*", *keys).drop("index"), "index", *(f"_by{k}" for k in range(len(order)))).withColumn("index", F.col("index") - 1)
    return out.select(*df.columns if "index" in df.columns else [*df.columns, "index"])


def area_filter(df: DataFrame, least: float, *order: str) -> DataFrame:
    """Objects of at least the given area, numbered anew. F1."""
    return dense_index(df.where(F.col("area") >= least), *(order or ("t", "index")))


def resolve_features(columns: list[str], wanted: list[str]) -> list[str]:
    """Columns that the wanted names stand for: the name itself, name-0, name_norm, name_{min,max,mean,median,std};
    the normalised form is preferred, _init columns never match; in order of the names. F2."""
    found: dict[str, str] = {}
    for name in wanted:
        rule = re.compile(rf"{re.escape(name)}(-\d+|_\d+)?(_(?:min|max|mean|median|std))?(_norm)?")
        for c in columns:
            if rule.fullmatch(c) and not c.endswith("_init"):
                base = c.removesuffix("_norm")
                if base not in found or c.endswith("_norm"):
                    found[base] = c
    return [found[b] for b in sorted(found)]


def non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): how many values of each column are null, NaN or infinite. One scan. F2."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    counts = df.agg(*(F.count_if(bad(c)).alias(c) for c in columns))
    return counts.unpivot([], columns, "column", "n")


def aspect_ratio(df: DataFrame) -> DataFrame:
    """ln of the axes' ratio, each at least 1. F3."""
    one = F.lit(1.0)
    return df.withColumn("aspect_ratio", F.log(F.greatest("axis_major_length", one) / F.greatest("axis_minor_length", one)))


def size_normalisation(df: DataFrame, columns: list[str]) -> DataFrame:
    """x_norm = ln((x + e) / (m + e)) with m the median length or area of the sequence's first frame.

    Null or zero medians count as 1. len_init and area_init hold the medians. F6."""
    first = df.withColumn("_t0", F.min("t").over(Window.partitionBy(SEQ))).where("t = _t0")
    medians = first.groupBy(SEQ).agg(F.median("axis_major_length").alias("len_init"), F.median("area").alias("area_init"))
    safe = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, 1.0).otherwise(F.col(c))
    given = df.join(medians.select(SEQ, safe("len_init").alias("len_init"), safe("area_init").alias("area_init")), SEQ, "left")
    scale = lambda c: F.col("len_init") if any(k in c for k in LENGTHS) else F.col("area_init")
    normed = given.withColumns({f"{c}_norm": F.log((F.col(c) + EPS) / (scale(c) + EPS)) for c in columns})
    return normed.withColumns({c: F.col(c).cast("float") for c in ("len_init", "area_init")})


def expected_size(df: DataFrame) -> DataFrame:
    """(sequence_id, size): the first known len_init, else the median major axis of the first frame, else 1. A25."""
    first = df.withColumn("_t0", F.min("t").over(Window.partitionBy(SEQ)))
    given = F.min_by("len_init", F.when(F.col("len_init").isNotNull(), F.col("index"))) if "len_init" in df.columns else F.lit(None).cast("double")
    median = F.median(F.when(F.col("t") == F.col("_t0"), F.col("axis_major_length")))
    return first.groupBy(SEQ).agg(F.coalesce(given.cast("double"), median, F.lit(1.0)).alias("size"))


def search_radius(df: DataFrame, spec: int | str | tuple) -> DataFrame:
    """(sequence_id, radius): an int, or "2.5x" of the expected size, at least 1; F30. A range gives low and high."""
    if isinstance(spec, str):
        if not re.fullmatch(r"\d+(\.\d+)?x", spec):
            raise ValueError(f"a radius is a number, a range or a factor such as 2.5x, not {spec!r}")
        return expected_size(df).select(SEQ, F.greatest(F.lit(1), F.rint(F.col("size") * float(spec[:-1]))).cast("int").alias("radius"))
    low, high = spec if isinstance(spec, tuple) else (spec, spec)
    return df.select(SEQ).distinct().select(SEQ, F.lit(low).alias("radius"), F.lit(high).alias("radius_high"))


def to_global(df: DataFrame, axes: int = 2, name: str = "center") -> DataFrame:
    """Positions inside the bounding box become positions in the frame. F7."""
    return df.withColumns({f"{name}_{i}": F.col(f"{name}_local_{i}") + F.col(f"bbox_{i}") for i in range(axes)}).drop(*(f"{name}_local_{i}" for i in range(axes)))


def pixel_copies(df: DataFrame, spacing: tuple[float, ...], name: str = "center") -> DataFrame:
    """Positions in pixels next to those in physical units, unless they are the same. F8."""
    if all(s == 1 for s in spacing):
        return df
    return df.withColumns({f"{name}_{i}_px": F.col(f"{name}_{i}") / s for i, s in enumerate(spacing)})


def position_columns(columns: list[str]) -> list[str]:
    """Pixel positions before physical ones, center before centroid; axes must be 0..n-1. F9."""
    for name in ("center", "centroid"):
        for end in ("_px", ""):
            axes = sorted(int(m[1]) for c in columns if (m := re.fullmatch(rf"{name}_(\d)({end})", c)))
            if axes:
                if axes != list(range(len(axes))):
                    raise ValueError(f"axes of {name} are {axes}")
                return [f"{name}_{i}{end}" for i in axes]
    raise ValueError("no position columns")


def require(columns: list[str], needed: list[str]) -> None:
    """an error that names what is missing and what there is."""
    if missing := sorted(set(needed) - set(columns)):
        raise ValueError(f"missing columns {missing}; there are {sorted(columns)}")


def join_lineage(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """parent and state of each node from a states table, by (label, t); one row a node as before. J14."""
    once = states.groupBy(SEQ, "label", "t").agg(F.min("parent").alias("parent"), F.min("state").alias("state"))
    return nodes.drop("parent", "state").join(once, [SEQ, "label", "t"], "left")


def unmatched_lineage(nodes: DataFrame, lineage: DataFrame) -> DataFrame:
    """(sequence_id, label, side): labels of the lineage without node, and of nodes without lineage. J15, U3."""
    a, b = lineage.select(SEQ, "label").distinct(), nodes.select(SEQ, "label").distinct()
    return a.join(b, [SEQ, "label"], "left_anti").withColumn("side", F.lit("lineage")).union(b.join(a, [SEQ, "label"], "left_anti").withColumn("side", F.lit("nodes")))


def frames(nodes: DataFrame) -> DataFrame:
    """(sequence_id, t, valid) for every frame from 0 to the last. A7."""
    present = nodes.groupBy(SEQ, "t").agg(F.lit(True).alias("valid"))
    every = nodes.groupBy(SEQ).agg(F.max("t").alias("_last")).select(SEQ, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("t"))
    return every.join(present, [SEQ, "t"], "left").select(SEQ, "t", F.coalesce("valid", F.lit(False)).alias("valid"))


def frame_centres(nodes: DataFrame, t: int) -> DataFrame:
    """index and centre vector of one frame. F42."""
    return nodes.where(F.col("t") == t).select(SEQ, "index", F.array(*position_columns(nodes.columns)).alias("centre"))


def crop_boxes(nodes: DataFrame, size: float, height: int, width: int) -> DataFrame:
    """A square box of the given side about each node, shifted to lie inside the frame. N1."""
    half = size / 2
    low = lambda c, most: F.greatest(F.lit(0), F.least(F.floor(F.col(c) - half), F.lit(most) - int(size)))
    given = nodes.withColumns({"crop_0": low("center_0", height).cast("int"), "crop_1": low("center_1", width).cast("int")})
    return given.withColumns({"crop_2": F.col("crop_0") + int(size), "crop_3": F.col("crop_1") + int(size)})


#: Ways to choose the side of a crop; all but the first two need a plane, volumes take the box in the plane instead.
BOX_MODES = ("fixed", "bbox", "axis_major_length", "len_init", "median_size")


def sized_boxes(nodes: DataFrame, frame: tuple[int, int], mode: str = "bbox", scale: float = 1.0, side: int | None = None, shift: bool = True, centre: str = "center", spacing: tuple[float, ...] | None = None) -> DataFrame:
    """The nodes with side, crop_0 .. crop_3 (square, in pixels), src_ and dst_0 .. 3 (its part within the frame, and where
    that lies in the crop), padded (whether it runs past the frame), and z where the nodes have three axes. N1.

    Modes: a side for all; the larger side of the bounding box, about that box's middle; the node's own length; the
    median length of its sequence, exact and without a buffer; each times ``scale``, cut to whole pixels, lengths
    divided by the mean spacing in the plane. With ``shift`` a box is moved inside its frame; one larger than the frame
    then starts before it. A node without position or size gets nulls."""
    if mode not in BOX_MODES:
        raise ValueError(f"unknown mode {mode!r}; there are {BOX_MODES}")
    if mode == "fixed" and side is None:
        raise ValueError("mode fixed needs a side")
    n = sum(f"{centre}_{i}" in nodes.columns for i in range(3))
    if n < 2:
        raise ValueError(f"no columns {centre}_0, {centre}_1; there are {sorted(nodes.columns)}")
    volume = n == 3
    at = lambda i: F.col(f"{centre}_{i}_px" if f"{centre}_{i}_px" in nodes.columns else f"{centre}_{i}").cast("int")
    first = [f"bbox_{i}" for i in range(n)][-2:]
    last = [f"bbox_{n + i}" for i in range(n)][-2:]
    in_plane = mode == "bbox" or (volume and mode != "fixed")
    require(nodes.columns, [*(first + last if in_plane else []), *([mode] if mode in ("axis_major_length", "len_init") and not volume else [])])
    unit = sum(spacing[-2:]) / 2 if spacing else 1.0
    given = nodes
    if mode == "fixed":
        size = F.lit(side)
    elif in_plane:
        size = F.greatest(*(F.col(b) - F.col(a) for a, b in zip(first, last, strict=True))) * F.lit(float(scale))
    elif mode == "median_size":
        median = quantiles(nodes, "axis_major_length", [0.5], [SEQ]).select(F.col(SEQ).alias("_seq"), F.element_at("q", 1).alias("_median"))
        given = nodes.join(median, F.col(SEQ).eqNullSafe(F.col("_seq")), "left").drop("_seq")
        size = F.col("_median") / unit * F.lit(float(scale))
    else:
        size = F.col(mode) / unit * F.lit(float(scale))
    given = given.withColumn("side", size.cast("int"))
    half = F.floor(F.col("side") / 2)
    low = []
    for i, most in enumerate(frame):
        middle = F.floor((F.col(first[i]) + F.col(last[i])) / 2) if mode == "bbox" else at(n - 2 + i)
        ideal = middle - half
        # Neither least nor greatest gives null for a null among its arguments.
        moved = F.least(F.greatest(ideal, F.lit(0)), F.lit(most) - F.col("side")) if shift else ideal
        low.append(F.when(ideal.isNotNull(), moved).cast("int"))
    given = given.withColumns({"crop_0": low[0], "crop_1": low[1]}).withColumns({"crop_2": F.col("crop_0") + F.col("side"), "crop_3": F.col("crop_1") + F.col("side")})
    within = lambda c, most: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0)), F.lit(most)))
    given = given.withColumns({f"src_{i}": within(f"crop_{i}", frame[i % 2]) for i in range(4)})
    given = given.withColumns({f"dst_{i}": F.col(f"src_{i}") - F.col(f"crop_{i % 2}") for i in range(4)})
    given = given.withColumn("padded", (F.col("src_2") - F.col("src_0") != F.col("side")) | (F.col("src_3") - F.col("src_1") != F.col("side")))
    return (given.withColumn("z", at(0)) if volume else given).drop("_median")


def percentile_scale(df: DataFrame, value: str = "intensity", low: float = 0.0005, high: float = 0.9995) -> DataFrame:
    """The value between two exact percentiles of its sequence, clipped to [0, 1]. S15, S17."""
    p = quantiles(df, value, [low, high], [SEQ]).select(SEQ, F.col("q").alias("_p"))
    given = df.join(p, SEQ)
    lo, hi = F.element_at("_p", 1), F.element_at("_p", 2)
    width = F.when(hi - lo == 0, 1.0).otherwise(hi - lo)
    return given.withColumn("scaled", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - lo) / width))).drop("_p")


def initial_scale(columns: list[str]) -> Column:
    return F.col("len_init") if "len_init" in columns else F.lit(1.0)


def uses_intensity(wanted: list[str], deep: bool = False) -> bool:
    """Whether images are needed: for an image encoder, or a property made of intensities. Without, the column isn't read. F43."""
    return deep or any("intensity" in name for name in wanted)


def centremost(nodes: DataFrame, height: float, width: float) -> DataFrame:
    """The node of each frame that is nearest to the frame's middle; ties go to the smaller index. P4.

    Nodes without a position take no part, so a frame that has no others gives no row."""
    d = F.pow(F.col("center_0") - height / 2, 2) + F.pow(F.col("center_1") - width / 2, 2)
    near = nodes.where("center_0 is not null and center_1 is not null").groupBy(SEQ, "t").agg(F.min(F.struct(d.alias("d"), "index", "label")).alias("x"))
    return near.select(SEQ, "t", "x.index", "x.label")
