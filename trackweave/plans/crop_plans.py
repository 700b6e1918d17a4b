"""Plans over crops of single objects and their shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.operators import chain, correction, crops
from trackweave.operators.nodes import sized_boxes, uses_intensity
from trackweave.operators.pixels import region_properties
from trackweave.plans.ddb import r, sql
from trackweave.plans.registry import plan
from trackweave.sources import adapters as a

SIDE = 8


def _boxes(spark, d):
    """A box about the first pixel of each label, which may run past the frame's beginning."""
    p = a.pixels(spark, d).where("label != 0")
    first = p.groupBy("sequence_id", "t", "label").agg(F.min(F.struct("y", "x")).alias("p"))
    low = lambda c: (F.col(f"p.{c}") - SIDE // 2).cast("int")
    return first.select("sequence_id", "t", (F.col("label") * 1000 + F.col("t")).cast("long").alias("index"), "label", low("y").alias("crop_0"), low("x").alias("crop_1"), F.lit(SIDE).alias("side"))


BOXES = f"boxes AS (SELECT sequence_id, t, CAST(label * 1000 + t AS BIGINT) AS index, label, min(struct_pack(y := y, x := x)).y - {SIDE // 2} AS c0, min(struct_pack(y := y, x := x)).x - {SIDE // 2} AS c1 FROM pixels WHERE label <> 0 GROUP BY sequence_id, t, label), met AS (SELECT b.sequence_id, b.t, b.index, p.y - c0 AS dy, p.x - c1 AS dx, p.intensity, p.label = b.label AS own FROM boxes b JOIN pixels p ON p.sequence_id = b.sequence_id AND p.t = b.t AND p.y BETWEEN c0 AND c0 + {SIDE - 1} AND p.x BETWEEN c1 AND c1 + {SIDE - 1})"


@plan("n2_crop_pixels", sql(f"+{BOXES} SELECT sequence_id, t, index, count(*) AS n, count(*) FILTER (WHERE own) AS n_own, {r('sum(intensity)', 'total')} FROM met GROUP BY sequence_id, t, index", "pixels"))
def _n2(spark, d):
    met = crops.crop_pixels(a.pixels(spark, d), _boxes(spark, d))
    return met.groupBy("sequence_id", "t", "index").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("n_own"), (F.round(F.sum("intensity"), 6) + 0.0).alias("total"))


@plan("n2_resized_crops", sql(f"+{BOXES} SELECT m.sequence_id, m.t, m.index, CAST(k.range AS INTEGER) AS k, {r('coalesce(sum(intensity) FILTER (WHERE dy // 2 = k.range // 4 AND dx // 2 = k.range % 4), 0) / 4', 'value')} FROM met m, range(0, 16) k GROUP BY ALL", "pixels"))
def _n2_resized(spark, d):
    out = crops.crops(a.pixels(spark, d), _boxes(spark, d), SIDE // 2)
    return out.select("sequence_id", "t", "index", F.posexplode("patch").alias("k", "v")).select("sequence_id", "t", "index", "k", (F.round("v", 6) + 0.0).alias("value"))


#: Added before rounding: sums that end in half a unit come out alike in whichever order they were summed.
HAIR = 1e-9
SMOOTH = f"weights AS (SELECT i.range AS i, j.range AS j, greatest(0, 1 - abs(j.range + 0.5 - (i.range + 0.5) * 2) / 2) / sum(greatest(0, 1 - abs(j.range + 0.5 - (i.range + 0.5) * 2) / 2)) OVER (PARTITION BY i.range) AS w FROM range(0, {SIDE // 2}) i, range(0, {SIDE}) j)"


@plan("n2_smooth_crops", sql(f"+{BOXES}, {SMOOTH} SELECT m.sequence_id, m.t, m.index, CAST(a.i * {SIDE // 2} + b.i AS INTEGER) AS k, {r(f'sum(coalesce(m.intensity, 0) * a.w * b.w) + {HAIR}', 'value')} FROM met m JOIN weights a ON a.j = m.dy JOIN weights b ON b.j = m.dx GROUP BY ALL", "pixels"))
def _n2_smooth(spark, d):
    out = crops.crops(a.pixels(spark, d), _boxes(spark, d), SIDE // 2, smooth=True)
    return out.select("sequence_id", "t", "index", F.posexplode("patch").alias("k", "v")).select("sequence_id", "t", "index", "k", (F.round(F.col("v") + HAIR, 6) + 0.0).alias("value"))


#: Frame and scale of the boxes by mode.
FRAME, SCALE = (512, 100), 1.5
GIVEN = ["crop_0", "crop_1", "crop_2", "crop_3", "src_0", "src_1", "src_2", "src_3", "dst_0", "dst_1", "dst_2", "dst_3"]


def _boxes_sql(size, middles, given, shift, keys="sequence_id, index"):
    """SQL of boxes by mode: the side, the two middles, and the rows they stand in."""
    ideal = [f"m{i} - side // 2" for i in (0, 1)]
    low = [f"least(greatest({e}, 0), {m} - side)" if shift else e for e, m in zip(ideal, FRAME, strict=True)]
    inside = lambda e, i: f"least(greatest({e}, 0), {FRAME[i]})"
    ends = ["c0", "c1", "c0 + side", "c1 + side"]
    cols = [f"CAST({e} AS INTEGER) AS crop_{k}" for k, e in enumerate(ends)] + [f"CAST({inside(e, k % 2)} AS INTEGER) AS src_{k}" for k, e in enumerate(ends)] + [f"CAST({inside(e, k % 2)} - {ends[k % 2]} AS INTEGER) AS dst_{k}" for k, e in enumerate(ends)]
    padded = f"({inside('c0 + side', 0)} - {inside('c0', 0)} <> side OR {inside('c1 + side', 1)} - {inside('c1', 1)} <> side) AS padded"
    return f"+sized AS (SELECT {keys}, CAST(trunc({size}) AS BIGINT) AS side, CAST({middles[0]} AS BIGINT) AS m0, CAST({middles[1]} AS BIGINT) AS m1 FROM {given}), low AS (SELECT *, {low[0]} AS c0, {low[1]} AS c1 FROM sized) SELECT {keys}, CAST(side AS INTEGER) AS side, {', '.join(cols)}, {padded} FROM low"


TRUNC = ["trunc(center_0)", "trunc(center_1)"]


@plan("n1_boxes_by_bbox", sql(_boxes_sql(f"greatest(b2 - b0, b3 - b1) * {SCALE}", ["(b0 + b2) // 2", "(b1 + b3) // 2"], "(SELECT sequence_id, t, label, min(y) AS b0, min(x) AS b1, max(y) + 1 AS b2, max(x) + 1 AS b3 FROM pixels WHERE label <> 0 GROUP BY ALL)", True, "sequence_id, t, label"), "pixels"))
def _n1_bbox(spark, d):
    own = region_properties(a.pixels(spark, d)).withColumns({f"center_{i}": F.col(f"centroid_{i}") for i in (0, 1)})
    return sized_boxes(own, FRAME, "bbox", SCALE).select("sequence_id", "t", "label", "side", *GIVEN, "padded")


@plan("n1_boxes_by_length", sql(_boxes_sql(f"axis_major_length * {SCALE}", TRUNC, "nodes", False), "nodes"))
def _n1_length(spark, d):
    return sized_boxes(a.nodes(spark, d), FRAME, "axis_major_length", SCALE, shift=False).select("sequence_id", "index", "side", *GIVEN, "padded")


@plan("n1_boxes_by_median", sql(_boxes_sql(f"median * {SCALE}", TRUNC, "(SELECT *, quantile_cont(axis_major_length, 0.5) OVER (PARTITION BY sequence_id) AS median FROM nodes)", True), "nodes"))
def _n1_median(spark, d):
    return sized_boxes(a.nodes(spark, d), FRAME, "median_size", SCALE).select("sequence_id", "index", "side", *GIVEN, "padded")


@plan("n3_patch_weights", sql(f"+{BOXES} SELECT m.sequence_id, m.t, m.index, CAST(k.range AS INTEGER) AS k, {r('count(*) FILTER (WHERE own AND dy // 4 = k.range // 2 AND dx // 4 = k.range % 2) / 16', 'weight')} FROM met m, range(0, 4) k GROUP BY ALL", "pixels"))
def _n3(spark, d):
    out = crops.crops(a.pixels(spark, d), _boxes(spark, d), SIDE, patch=SIDE // 2)
    return out.select("sequence_id", "t", "index", F.posexplode("weights").alias("k", "w")).select("sequence_id", "t", "index", "k", (F.round("w", 6) + 0.0).alias("weight"))


@plan("a3_shapes")
def _a3(spark, d):
    return crops.shapes(a.pixels(spark, d))


@plan("f43_intensity_requirement", sql(f"SELECT sequence_id, t, label, count(*) AS area, {r('avg(y)', 'centroid_0')} FROM pixels WHERE label <> 0 GROUP BY ALL", "pixels"))
def _f43(spark, d):
    wanted = ["area", "centroid"]
    given = a.pixels(spark, d)
    given = given if uses_intensity(wanted) else given.drop("intensity")
    return region_properties(given).select("sequence_id", "t", "label", "area", (F.round("centroid_0", 6) + 0.0).alias("centroid_0"))


def _families(spark, d, cells):
    """A family of cells for each trajectory of ``tracks``, in bands of their own. cells: of a label column l, (label,
    parent, first frame, last frame, y, x) as SQL; each cell is a square of 2 x 2 pixels about its corner."""
    base = a.tracks(spark, d).where("label_track > 0").select(F.col("label_track").alias("l")).distinct()
    each = F.array(*(F.struct(F.lit(k).alias("k"), *(F.expr(x).cast("long").alias(n) for n, x in zip(("label", "parent", "b", "e", "y", "x"), cell, strict=True))) for k, cell in enumerate(cells)))
    rows = base.select("l", F.explode(each).alias("c")).select("l", "c.*").withColumn("t", F.explode(F.sequence("b", "e")))
    rows = rows.withColumn("sequence_id", F.concat(F.lit("s"), (F.col("l") % 16).cast("string")))
    tracks = rows.select("sequence_id", (F.col("l") * 1000 + F.col("t") * 10 + F.col("k")).alias("index"), F.col("t").cast("int").alias("t"), F.col("label").alias("label_track"), F.col("parent").alias("parent_track"), F.col("y").cast("double").alias("center_0"), F.col("x").cast("double").alias("center_1"), F.lit("original").alias("cell_source"))
    square = F.explode(F.array(*(F.struct(F.lit(dy).alias("y"), F.lit(dx).alias("x")) for dy in (0, 1) for dx in (0, 1))))
    pixels = rows.withColumn("o", square).select("sequence_id", F.col("t").cast("int").alias("t"), (F.col("y") + F.col("o.y")).cast("int").alias("y"), (F.col("x") + F.col("o.x")).cast("int").alias("x"), "label")
    return base, tracks, pixels


def _links(base, *links):
    """Scored links of each family: (condition, source index, target index, p1, p2) as SQL of l."""
    every = None
    for when, src, dst, p1, p2 in links:
        some = base.where(when).select(F.concat(F.lit("s"), (F.col("l") % 16).cast("string")).alias("sequence_id"), F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.lit(p1).alias("p1"), F.lit(p2).alias("p2"))
        every = some if every is None else every.union(some)
    return every


#: Parent, its daughters, and the cell that they become again; in three of four families the daughters don't touch, the
#: cell is elsewhere, or the link to it is weak.
EARLY = (("l", "0", "0", "5", "l * 10", "10"), ("1000000 + 2 * l", "l", "6", "8", "l * 10", "10"), ("1000001 + 2 * l", "l", "6", "12", "l * 10", "if(l % 4 = 1, 15, 12)"), ("2000000 + l", "0", "13", "20", "l * 10 + if(l % 4 = 2, 5, 0)", "11"))


@plan("c4_early_divisions", sql("SELECT DISTINCT 's' || (label_track % 16) AS sequence_id, label_track AS parent, 1000000 + 2 * label_track AS label, 1000001 + 2 * label_track AS sibling, 2000000 + label_track AS successor FROM tracks WHERE label_track > 0 AND label_track % 4 = 0", "tracks"))
def _c4(spark, d):
    base, tracks, pixels = _families(spark, d, EARLY)
    preds = _links(base, ("l % 4 = 3", "l * 1000 + 122", "l * 1000 + 133", 0.4, 0.0), ("true", "-l", "-l - 1", 0.1, 0.0))
    return correction.early_divisions(tracks, pixels, preds).select("sequence_id", "parent", "label", "sibling", "successor")


#: Parent, two daughters, one mask over both, and the two cells behind it; in three of four families only one of these
#: is linked, the mask lasts too long, or one daughter has ended before.
MERGED = (
    ("l", "0", "0", "2", "l * 10", "10"), ("1000000 + 2 * l", "l", "3", "5", "l * 10", "10"), ("1000001 + 2 * l", "l", "3", "if(l % 4 = 3, 4, 5)", "l * 10", "12"), ("2000000 + l", "0", "6", "if(l % 4 = 2, 10, 7)", "l * 10", "11"),
    ("3000000 + l", "2000000 + l", "if(l % 4 = 2, 11, 8)", "14", "l * 10", "10"), ("4000000 + l", "2000000 + l", "if(l % 4 = 2, 11, 8)", "14", "l * 10", "12"),
)


def _merged(spark, d):
    base, tracks, pixels = _families(spark, d, MERGED)
    behind = "l * 1000 + if(l % 4 = 2, 110, 80)"
    return tracks, pixels, _links(base, ("true", "l * 1000 + 63", f"{behind} + 4", 0.1, 0.9), ("l % 4 != 1", "l * 1000 + 63", f"{behind} + 5", 0.1, 0.8))


@plan("c5_merged_daughters", sql("SELECT DISTINCT 's' || (label_track % 16) AS sequence_id, label_track AS parent, 1000000 + 2 * label_track AS a, 1000001 + 2 * label_track AS b, 2000000 + label_track AS merged, 6 AS t, label_track * 1000 + 84 AS after_a, label_track * 1000 + 85 AS after_b FROM tracks WHERE label_track > 0 AND label_track % 4 = 0", "tracks"))
def _c5(spark, d):
    return correction.merged_daughters(*_merged(spark, d)).select("sequence_id", "parent", "a", "b", "merged", "t", "after_a", "after_b")


@plan("c7_split_tracks", sql("+u AS (SELECT DISTINCT label_track AS l FROM tracks WHERE label_track > 0 AND label_track % 4 = 0), k AS (SELECT l, k.range AS k, t.range AS t FROM u, range(0, 2) k, range(3, 15) t) SELECT 's' || (l % 16) AS sequence_id, 1000000 + 2 * l + k AS label_track, CAST(t AS INTEGER) AS t, l AS parent_track, CASE WHEN t = 6 THEN 'split' ELSE 'original' END AS cell_source FROM k WHERE t <> 7", "tracks"))
def _c7(spark, d):
    """The daughters' rows when merged masks are split: in the merge's frame and on, as what comes behind it."""
    tracks, pixels, preds = _merged(spark, d)
    done = chain.split_merged_daughters()(chain.State(tracks, pixels, preds)).tracks
    return done.where("label_track >= 1000000 and label_track < 2000000").where("((label_track - 1000000) div 2) % 4 = 0").select("sequence_id", "label_track", "t", "parent_track", "cell_source")
