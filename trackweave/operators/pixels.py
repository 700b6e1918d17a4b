"""Region properties of labelled pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.operators.components import components
from trackweave.operators.lineage import _written

SEQ = "sequence_id"


def region_properties(pixels: DataFrame) -> DataFrame:
    """Area, half-open bounding box, centroid, axes, orientation, eccentricity and, with images, intensities of each label. A2.

    Axes are 4 sqrt(eigenvalue) of the pixels' population covariance; orientation is the angle of the major axis from
    the first axis, in (-pi/2, pi/2]."""
    own = pixels.where("label != 0")
    light = [f("intensity").alias(f"intensity_{n}") for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))] if "intensity" in pixels.columns else []
    moments = own.groupBy(SEQ, "t", "label").agg(
        F.count(F.lit(1)).alias("area"), F.min("y").alias("bbox_0"), F.min("x").alias("bbox_1"), (F.max("y") + 1).alias("bbox_2"), (F.max("x") + 1).alias("bbox_3"), F.avg("y").alias("centroid_0"), F.avg("x").alias("centroid_1"),
        F.var_pop("y").alias("_yy"), F.var_pop("x").alias("_xx"), F.covar_pop("y", "x").alias("_yx"), *light,
    )
    half, root = (F.col("_yy") + F.col("_xx")) / 2, F.sqrt(F.pow((F.col("_yy") - F.col("_xx")) / 2, 2) + F.pow("_yx", 2))
    major, minor = half + root, F.greatest(half - root, F.lit(0.0))
    given = moments.withColumns({"axis_major_length": 4 * F.sqrt(major), "axis_minor_length": 4 * F.sqrt(minor), "orientation": 0.5 * F.atan2(2 * F.col("_yx"), F.col("_yy") - F.col("_xx"))})
    ratio = F.when(major > 0, F.sqrt(F.greatest(1 - minor / major, F.lit(0.0)))).otherwise(0.0)
    return given.withColumn("eccentricity", ratio).drop("_yy", "_xx", "_yx")


def symmetric_eigenvalues(a: list[list[Column]]) -> tuple[Column, Column, Column]:
    """The eigenvalues of a symmetric 3 x 3 matrix of columns, falling, by the trigonometric solution of its cubic."""
    q = (a[0][0] + a[1][1] + a[2][2]) / 3
    d = [a[i][i] - q for i in range(3)]
    p = F.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2 * (a[0][1] * a[0][1] + a[0][2] * a[0][2] + a[1][2] * a[1][2])) / 6)
    det = d[0] * (d[1] * d[2] - a[1][2] * a[1][2]) - a[0][1] * (a[0][1] * d[2] - a[1][2] * a[0][2]) + a[0][2] * (a[0][1] * a[1][2] - d[1] * a[0][2])
    ratio = F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))).otherwise(1.0)
    angle = F.acos(ratio) / 3
    first, last = q + 2 * p * F.cos(angle), q + 2 * p * F.cos(angle + 2 * math.pi / 3)
    return first, 3 * q - first - last, last


def region_properties_3d(voxels: DataFrame) -> DataFrame:
    """As region_properties for voxels (sequence_id, t, z, y, x, label): area is the volume; boxes and centroids have three
    axes in the order z, y, x; axis lengths are those of the ellipsoid with the same second moments. A2."""
    own, axes = voxels.where("label != 0"), ("z", "y", "x")
    light = [f("intensity").alias(f"intensity_{n}") for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))] if "intensity" in voxels.columns else []
    sides = [e for i, c in enumerate(axes) for e in (F.min(c).alias(f"bbox_{i}"), (F.max(c) + 1).alias(f"bbox_{i + 3}"), F.avg(c).alias(f"centroid_{i}"))]
    second = [(F.var_pop(p) if p == q else F.covar_pop(p, q)).alias(f"_{p}{q}") for i, p in enumerate(axes) for q in axes[i:]]
    given = own.groupBy(SEQ, "t", "label").agg(F.count(F.lit(1)).alias("area"), *sides, *second, *light)
    matrix = [[F.col(f"_{axes[min(i, j)]}{axes[max(i, j)]}") for j in range(3)] for i in range(3)]
    values = symmetric_eigenvalues(matrix)
    length = lambda v: F.sqrt(20 * F.greatest(v, F.lit(0.0)))
    given = given.withColumns({"axis_major_length": length(values[0]), "axis_minor_length": length(values[2])})
    return given.drop(*(f"_{p}{q}" for i, p in enumerate(axes) for q in axes[i:]))


def instance_check(pixels: DataFrame, frames: int = 16) -> DataFrame:
    """Labels in evenly spaced frames, and whether each has a single one: then it is no instance mask. S6."""
    last = pixels.groupBy(SEQ).agg(F.max("t").alias("_last"))
    at = last.select(SEQ, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda k: F.floor(k * F.col("_last") / (frames - 1)).cast("int")))).alias("t"))
    return pixels.join(at, [SEQ, "t"], "left_semi").where("label != 0").groupBy(SEQ, "t").agg(F.countDistinct("label").alias("labels"))


def thickness(pixels: DataFrame) -> DataFrame:
    """Twice the largest distance of a label's pixel to what isn't its own. A4.

    Along columns the distance follows from the runs of the label; along rows a pixel looks as far as that distance, so
    the work is the objects' area times their half-width."""
    own = pixels.where("label != 0").select(SEQ, "t", "label", "y", "x").distinct()
    run = Window.partitionBy(SEQ, "t", "label", "x", "_run")
    own = own.withColumn("_run", F.col("y") - F.row_number().over(Window.partitionBy(SEQ, "t", "label", "x").orderBy("y")))
    own = own.withColumn("_g", F.least(F.col("y") - F.min("y").over(run), F.max("y").over(run) - F.col("y")) + 1).drop("_run")
    ways = own.withColumn("_dx", F.explode(F.sequence(-F.col("_g"), F.col("_g")))).withColumn("_at", F.col("x") + F.col("_dx"))
    side = own.select(SEQ, "t", "label", "y", F.col("x").alias("_at"), F.col("_g").alias("_h"))
    far = F.col("_dx") * F.col("_dx") + F.coalesce(F.col("_h") * F.col("_h"), F.lit(0))
    near = ways.join(side, [SEQ, "t", "label", "y", "_at"], "left").groupBy(SEQ, "t", "label", "y", "x").agg(F.min(far).alias("d"))
    return near.groupBy(SEQ, "t", "label").agg((2 * F.sqrt(F.max("d"))).alias("thickness"))


def runs(pixels: DataFrame) -> DataFrame:
    """(sequence_id, t, label, y, x0, x1): unbroken stretches of a label along the rows of its frames, both ends in."""
    own = pixels.where("label != 0").select(SEQ, F.col("t").cast("int").alias("t"), F.col("label").cast("long").alias("label"), "y", "x").distinct()
    row = Window.partitionBy(SEQ, "t", "label", "y").orderBy("x")
    return own.withColumn("_run", F.col("x") - F.row_number().over(row)).groupBy(SEQ, "t", "label", "y", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_run")


def labelled_runs(pixels: DataFrame) -> DataFrame:
    """The runs with the 8-connected part that each belongs to, part: runs of neighbouring rows that touch are linked and
    linked ones share a component, so a frame of any size is many rows and never one group."""
    given = _written(runs(pixels).withColumn("index", F.monotonically_increasing_id()), "runs").hint("merge")
    below = given.select(SEQ, "t", "label", (F.col("y") - 1).alias("y"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("index").alias("dst"))
    links = given.join(below, [SEQ, "t", "label", "y"]).where("_x0 <= x1 + 1 and _x1 >= x0 - 1").select(SEQ, F.col("index").alias("src"), "dst")
    return given.join(components(links), [SEQ, "index"], "left").withColumn("part", F.coalesce("component", "index")).select(SEQ, "t", "label", "y", "x0", "x1", "part")


def connected_parts(pixels: DataFrame) -> DataFrame:
    """(sequence_id, t, label, part, size): 8-connected parts of each label, largest first, ties by first pixel. C14."""
    first = F.min(F.struct("y", "x0")).alias("_first")
    sizes = labelled_runs(pixels).groupBy(SEQ, "t", "label", "part").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("size"), first)
    order = Window.partitionBy(SEQ, "t", "label").orderBy(F.desc("size"), "_first")
    return sizes.withColumn("part", (F.row_number().over(order) - 1).cast("long")).select(SEQ, "t", "label", "part", "size")


def content_identity(pixels: DataFrame) -> DataFrame:
    """A digest of each frame's pixels in order; equal frames have equal digests. A24."""
    cell = F.struct("y", "x", "label")
    return pixels.groupBy(SEQ, "t").agg(F.sha2(F.concat_ws(";", F.transform(F.sort_array(F.collect_list(cell)), lambda c: F.concat_ws(",", c["y"], c["x"], c["label"]))), 256).alias("digest"))


#: Mean and standard deviation of each colour channel that image encoders trained on ImageNet expect.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def normalised_channels(pixels: DataFrame) -> DataFrame:
    """channel_0..2: the intensity as each colour channel, at that channel's mean and deviation. Null stays null. N4."""
    return pixels.withColumns({f"channel_{k}": (F.col("intensity") - mean) / std for k, (mean, std) in enumerate(zip(CHANNEL_MEAN, CHANNEL_STD, strict=True))})
