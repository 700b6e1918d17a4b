"""Checks and repairs of trajectories: gaps, orphans, merged and split cells. tracks: see sources.adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.operators.lineage import _written
from trackweave.operators.numbering import numbered

SEQ = "sequence_id"


def merged_in_joins(*tables: DataFrame) -> list[DataFrame]:
    """The tables, which joins are to merge: Spark's estimate of them leaves out the copies that an explode has made, and
    would send them, or what is grouped from them, to every executor through the driver."""
    return [t.hint("merge") for t in tables]


def gaps(tracks: DataFrame, most: int | None = None) -> DataFrame:
    """Neighbouring rows of a trajectory with missing frames between, at most ``most`` of them. W2."""
    w = Window.partitionBy(SEQ, "label_track").orderBy("t", "index")
    given = tracks.select(SEQ, "label_track", "index", "t", "center_0", "center_1", *(F.lead(c).over(w).alias(f"next_{c}") for c in ("index", "t", "center_0", "center_1")))
    found = given.withColumn("t_diff", F.col("next_t") - F.col("t")).where("t_diff > 1")
    return found if most is None else found.where(F.col("t_diff") - 1 <= most)


def fill_gaps(tracks: DataFrame, most: int | None = None) -> DataFrame:
    """A row for each missing frame, its position between the neighbours', cell_source interpolated. C2, F33, C16.

    index follows the sequence's largest in order of label and frame; other columns are null."""
    rows = gaps(tracks, most).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("t_diff") - 1)))
    between = lambda i: F.col(f"center_{i}") + (F.col(f"next_center_{i}") - F.col(f"center_{i}")) * F.col("step") / F.col("t_diff")
    last = tracks.groupBy(SEQ).agg(F.max("index").alias("_last"))
    parents = tracks.groupBy(SEQ, "label_track").agg(F.max("parent_track").alias("parent_track"))
    made = rows.select(SEQ, "label_track", (F.col("t") + F.col("step")).cast("int").alias("t"), between(0).alias("center_0"), between(1).alias("center_1"), F.lit("interpolated").alias("cell_source"))
    made = numbered(made, "index", "label_track", "t").join(last, SEQ).join(parents, [SEQ, "label_track"])
    made = made.withColumn("index", F.col("_last") + F.col("index")).drop("_last")
    return tracks.unionByName(made, allowMissingColumns=True)


def division_gaps(tracks: DataFrame) -> DataFrame:
    """Parents that end more than a frame before the first of their daughters begins. J22."""
    ends = tracks.groupBy(SEQ, F.col("label_track").alias("parent")).agg(F.max("t").alias("parent_last"))
    first = tracks.where("parent_track > 0").groupBy(SEQ, F.col("parent_track").alias("parent")).agg(F.min("t").alias("first"))
    return ends.join(first, [SEQ, "parent"]).where("first - parent_last > 1").select(SEQ, "parent", "parent_last", "first")


def late_daughters(tracks: DataFrame) -> DataFrame:
    """Daughters that begin more than a frame after their parent's end, each with the first frame of any of the parent's
    daughters: where parent_first is as late, the parent is one of ``division_gaps``. J22."""
    ends = tracks.groupBy(SEQ, F.col("label_track").alias("parent")).agg(F.max("t").alias("parent_last"))
    born = tracks.where("parent_track > 0").groupBy(SEQ, "label_track", F.col("parent_track").alias("parent")).agg(F.min("t").alias("first"))
    soonest = born.groupBy(SEQ, "parent").agg(F.min("first").alias("parent_first"))
    late = born.join(ends, [SEQ, "parent"]).where("first - parent_last > 1").join(soonest, [SEQ, "parent"])
    return late.select(SEQ, "label_track", "parent", "parent_last", "first", "parent_first")


def fill_division_gaps(tracks: DataFrame) -> DataFrame:
    """Rows that carry a parent on to the frame before its first daughters, towards the mean of their positions. C3."""
    found = division_gaps(tracks)
    start = tracks.groupBy(SEQ, F.col("label_track").alias("parent")).agg(F.max(F.struct("t", "index", "center_0", "center_1")).alias("p"))
    born = tracks.select(SEQ, F.col("parent_track").alias("parent"), F.col("t").alias("first"), "center_0", "center_1")
    daughters = found.join(born, [SEQ, "parent", "first"]).groupBy(SEQ, "parent", "parent_last", "first").agg(F.avg("center_0").alias("to_0"), F.avg("center_1").alias("to_1"))
    rows = daughters.join(start, [SEQ, "parent"]).withColumn("t", F.explode(F.sequence(F.col("parent_last") + 1, F.col("first") - 1)))
    part = (F.col("t") - F.col("parent_last")) / (F.col("first") - F.col("parent_last"))
    return rows.select(SEQ, F.col("parent").alias("label_track"), "t", *((F.col(f"p.center_{i}") + (F.col(f"to_{i}") - F.col(f"p.center_{i}")) * part).alias(f"center_{i}") for i in (0, 1)))


def split_at_gaps(tracks: DataFrame) -> DataFrame:
    """Trajectories cut at their gaps. The first piece keeps its label; the others get new ones from the sequence's
    largest on, in order of label and frame, and parent 0; children follow the piece that lives the frame before
    their birth. C11, W8."""
    w = Window.partitionBy(SEQ, "label_track").orderBy("t", "index")
    cut = F.when(F.col("t") - F.lag("t").over(w) > 1, 1).otherwise(0)
    given = tracks.withColumn("_c", cut).withColumn("_piece", F.sum("_c").over(w))
    pieces = given.groupBy(SEQ, "label_track", "_piece").agg(F.min("t").alias("_b"), F.max("t").alias("_e"))
    largest = tracks.groupBy(SEQ).agg(F.max("label_track").alias("_top"))
    new = numbered(pieces.where("_piece > 0"), "_new", "label_track", "_b").join(largest, SEQ).select(SEQ, "label_track", "_piece", (F.col("_top") + F.col("_new")).alias("_new"))
    named = pieces.join(new, [SEQ, "label_track", "_piece"], "left").withColumn("_name", F.coalesce("_new", "label_track"))
    born = tracks.groupBy(SEQ, "label_track").agg(F.min("t").alias("_birth"), F.max("parent_track").alias("_parent"))
    alive = named.select(SEQ, F.col("label_track").alias("_parent"), F.col("_name").alias("_alive"), "_b", "_e")
    follow = born.join(alive, [SEQ, "_parent"]).where("_birth - 1 between _b and _e").groupBy(SEQ, "label_track").agg(F.min("_alive").alias("_alive"))
    out = given.join(named.select(SEQ, "label_track", "_piece", "_name"), [SEQ, "label_track", "_piece"]).join(follow, [SEQ, "label_track"], "left")
    parent = F.when(F.col("_piece") > 0, F.lit(0)).otherwise(F.coalesce("_alive", "parent_track"))
    return out.withColumns({"parent_track": parent, "label_track": F.col("_name")}).select(*tracks.columns)


def drop_orphans(tracks: DataFrame, pixels: DataFrame) -> DataFrame:
    """Rows whose label has no pixel in their frame go; parents that no longer exist become 0. C10, A16."""
    there = pixels.where("label != 0").select(SEQ, "t", F.col("label").alias("label_track")).distinct()
    kept = tracks.join(there, [SEQ, "t", "label_track"], "left_semi")
    alive = kept.select(SEQ, F.col("label_track").alias("parent_track"), F.lit(True).alias("_alive")).distinct()
    given = kept.join(alive, [SEQ, "parent_track"], "left").withColumn("parent_track", F.when(F.col("_alive"), F.col("parent_track")).otherwise(0))
    return given.select(*tracks.columns)


def remove_rows(tracks: DataFrame, rows: DataFrame, clear_parents: bool = False) -> DataFrame:
    """Without the given (t, label_track); parents that were removed whole may become 0. J18."""
    left = tracks.join(rows.select(SEQ, "t", "label_track").distinct(), [SEQ, "t", "label_track"], "left_anti")
    if not clear_parents:
        return left.select(*tracks.columns)
    alive = left.select(SEQ, F.col("label_track").alias("parent_track"), F.lit(True).alias("_alive")).distinct()
    return left.join(alive, [SEQ, "parent_track"], "left").withColumn("parent_track", F.when(F.col("_alive"), F.col("parent_track")).otherwise(0)).select(*tracks.columns)


def relabel(tracks: DataFrame, mapping: DataFrame) -> DataFrame:
    """label and parent replaced by a map (sequence_id, old, new). C8, C17."""
    own, up = mapping.select(SEQ, F.col("old").alias("label_track"), F.col("new").alias("_l")), mapping.select(SEQ, F.col("old").alias("parent_track"), F.col("new").alias("_p"))
    given = tracks.join(own, [SEQ, "label_track"], "left").join(up, [SEQ, "parent_track"], "left")
    return given.withColumns({"label_track": F.coalesce("_l", "label_track"), "parent_track": F.coalesce("_p", "parent_track")}).select(*tracks.columns)


def relabel_from(tracks: DataFrame, old: int, new: int, since: int) -> DataFrame:
    """From a frame on, one label becomes another; daughters born later follow it. C9."""
    born = F.min("t").over(Window.partitionBy(SEQ, "label_track"))
    given = tracks.withColumn("_born", born)
    label = F.when((F.col("label_track") == old) & (F.col("t") >= since), new).otherwise(F.col("label_track"))
    parent = F.when((F.col("parent_track") == old) & (F.col("_born") > since), new).otherwise(F.col("parent_track"))
    return given.withColumns({"label_track": label, "parent_track": parent}).select(*tracks.columns)


def short_tracks(tracks: DataFrame, most: int, division_only: bool = False) -> DataFrame:
    """Last rows of trajectories of at most so many frames, unless the sequence ends too soon after them to tell. A13, W3.

    The sequence's end is the largest frame of all trajectories' last rows, short or not; division_only looks at
    trajectories with a parent alone, for the end as well."""
    w = Window.partitionBy(SEQ, "label_track")
    given = tracks.where("parent_track > 0" if division_only else "parent_track >= 0").withColumn("lifetime", F.max("t").over(w) - F.min("t").over(w) + 1)
    last = given.withColumn("_k", F.row_number().over(w.orderBy(F.desc("t"), F.desc("index")))).where("_k = 1").drop("_k")
    ends = last.groupBy(SEQ).agg(F.max("t").alias("_end"))
    return last.where(F.col("lifetime") <= most).join(ends, SEQ).where(F.col("t") + F.col("lifetime") <= F.col("_end")).drop("_end")


def division_statistics(tracks: DataFrame) -> DataFrame:
    """Daughters of each parent, their first frame, and in how many different frames they begin. A15."""
    first = tracks.groupBy(SEQ, "label_track").agg(F.min("t").alias("first"), F.max("parent_track").alias("parent")).where("parent > 0 and parent != label_track")
    return first.groupBy(SEQ, "parent").agg(F.countDistinct("label_track").alias("daughters"), F.min("first").alias("first"), F.countDistinct("first").alias("starts"))


def overlaps_parent(tracks: DataFrame) -> DataFrame:
    """Parent rows in or after a daughter's first frame. J21."""
    first = tracks.groupBy(SEQ, F.col("label_track").alias("daughter")).agg(F.min("t").alias("first"), F.max("parent_track").alias("label_track")).where("label_track > 0 and label_track != daughter")
    return tracks.select(SEQ, "label_track", "t").join(first, [SEQ, "label_track"]).where("t >= first").select(SEQ, "label_track", "daughter", "t")


def _hole_frames(tracks: DataFrame) -> DataFrame:
    """(sequence_id, outer, b, to): each missing frame b of a gap with the gap's last."""
    return gaps(tracks).select(SEQ, F.col("label_track").alias("outer"), (F.col("next_t") - 1).alias("to"), F.explode(F.sequence(F.col("t") + 1, F.col("next_t") - 1)).alias("b"))


def _by_first_frame(holes: DataFrame, spans: DataFrame) -> DataFrame:
    """Missing frames with the spans (inner, b, e) that begin in them. A sequence has few frames, and each may hold most
    trajectories, so a frame's gaps are dealt over salts and its spans stand in each of them."""
    n = int(holes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = holes.withColumn("_salt", F.pmod(F.xxhash64("outer"), F.lit(n)).cast("int"))
    copies = spans.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.join(copies.hint("merge"), [SEQ, "b", "_salt"]).drop("_salt")


def _spans(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy(SEQ, F.col("label_track").alias("inner")).agg(F.min("t").alias("b"), F.max("t").alias("e"))


def covering(tracks: DataFrame) -> DataFrame:
    """(sequence_id, inner, outer): trajectories that begin before and end after another within a gap of theirs: they
    share no frame. J23.

    The gaps of each trajectory are joined with the frames inside them, so pairs come from shared frames only. A frame is
    in one gap of a trajectory at most, so no pair comes twice."""
    return _by_first_frame(_hole_frames(tracks), _spans(tracks)).where("e <= to and inner != outer").select(SEQ, "inner", "outer")


def gap_only(tracks: DataFrame) -> DataFrame:
    """Trajectories whose span lies inside some other trajectory's gap. J24. No trajectory begins in a gap of its own, so
    the gap that reaches furthest from its first frame tells."""
    reach = _hole_frames(tracks).where("outer is not null").groupBy(SEQ, "b").agg(F.max("to").alias("to"))
    return _spans(tracks).where("inner is not null").join(reach, [SEQ, "b"]).where("e <= to").select(SEQ, F.col("inner").alias("label_track"))


def relatives(tracks: DataFrame) -> DataFrame:
    """(sequence_id, label, kind, other): siblings, parents and children. C13."""
    up = tracks.select(SEQ, F.col("label_track").alias("label"), F.col("parent_track").alias("other")).where("other > 0 and other != label").distinct()
    have = tracks.select(SEQ, F.col("label_track").alias("other")).distinct()
    up = up.join(have, [SEQ, "other"], "left_semi").select(SEQ, "label", "other")
    twins = up.join(up.select(SEQ, F.col("label").alias("sibling"), "other"), [SEQ, "other"]).where("label != sibling").select(SEQ, "label", F.lit("sibling").alias("kind"), F.col("sibling").alias("other"))
    return twins.union(up.select(SEQ, "label", F.lit("parent").alias("kind"), "other")).union(up.select(SEQ, F.col("other").alias("label"), F.lit("child").alias("kind"), F.col("label").alias("other")))


def shared_frames(tracks: DataFrame) -> DataFrame:
    """Frames that parent and daughter have in common. C13, U4."""
    child = tracks.select(SEQ, "t", F.col("label_track").alias("daughter"), F.col("parent_track").alias("label_track")).where("label_track > 0 and label_track != daughter")
    return child.join(tracks.select(SEQ, "t", "label_track"), [SEQ, "t", "label_track"]).groupBy(SEQ, "label_track", "daughter").agg(F.countDistinct("t").alias("n"))


def best_score(preds: DataFrame, by: str, score: str = "p1") -> DataFrame:
    """Largest score of the links of each end, 0 if there is none. A19."""
    return preds.groupBy(SEQ, F.col(by).alias("index")).agg(F.coalesce(F.max(score), F.lit(0.0)).alias("best"))


def strong_external(preds: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(sequence_id, group): groups with a link above the threshold of which exactly one end is a member. A20."""
    m = members.select(SEQ, "group", "index")
    one = preds.join(m.withColumnRenamed("index", "src"), [SEQ, "src"]).select(SEQ, "group", "src", "dst", "p1", "p2")
    two = preds.join(m.withColumnRenamed("index", "dst"), [SEQ, "dst"]).select(SEQ, "group", "src", "dst", "p1", "p2")
    both = one.join(two.select(SEQ, "group", "src", "dst").distinct(), [SEQ, "group", "src", "dst"], "left_semi").select(SEQ, "group", "src", "dst").distinct()
    touching = one.union(two).where(F.greatest("p1", "p2") > threshold)
    return touching.join(both, [SEQ, "group", "src", "dst"], "left_anti").select(SEQ, "group").distinct()


def top_targets(preds: DataFrame, n: int = 2, score: str = "p2") -> DataFrame:
    """The n best targets of each source. L4, W4."""
    w = Window.partitionBy(SEQ, "src").orderBy(F.desc(score), "dst")
    return preds.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def coverage(pixels: DataFrame, footprint: DataFrame) -> DataFrame:
    """What labels lie under a footprint (sequence_id, t, owner, y, x): shared pixels, coverage, IoU, and whether the
    label is in conflict at 0.5. A17."""
    size = footprint.groupBy(SEQ, "t", "owner").agg(F.count(F.lit(1)).alias("_f"))
    area = pixels.where("label != 0").groupBy(SEQ, "t", "label").agg(F.count(F.lit(1)).alias("_a"))
    met = footprint.join(pixels.where("label != 0"), [SEQ, "t", "y", "x"]).groupBy(SEQ, "t", "owner", "label").agg(F.count(F.lit(1)).alias("shared"))
    given = met.join(size, [SEQ, "t", "owner"]).join(area, [SEQ, "t", "label"])
    return given.select(SEQ, "t", "owner", "label", "shared", (F.col("shared") / F.col("_a")).alias("coverage"), (F.col("shared") / (F.col("_f") + F.col("_a") - F.col("shared"))).alias("iou")).withColumn("conflict", F.greatest("coverage", "iou") > 0.5)


def spread_score(gap: DataFrame, reference: DataFrame, background: DataFrame) -> DataFrame:
    """(std in the gap - std of the background) / (std of the reference - std of the background); 1 if the latter is
    nothing. All are (sequence_id, id, intensity). A18."""
    std = lambda df, name: df.groupBy(SEQ, "id").agg(F.stddev_pop("intensity").alias(name))
    given = std(gap, "g").join(std(reference, "r"), [SEQ, "id"]).join(std(background, "b"), [SEQ, "id"])
    return given.select(SEQ, "id", F.when(F.col("r") - F.col("b") <= 1e-6, 1.0).otherwise((F.col("g") - F.col("b")) / (F.col("r") - F.col("b"))).alias("score"))


def missing_markers(tracks: DataFrame) -> DataFrame:
    """(label, t) missing between begin and end, with the last earlier or else the first later position. G12."""
    ends = tracks.groupBy(SEQ, "label_track").agg(F.min("t").alias("b"), F.max("t").alias("e")).withColumn("t", F.explode(F.sequence("b", "e")))
    every = ends.select(SEQ, "label_track", "t").join(tracks.select(SEQ, "label_track", "t", "center_0", "center_1").dropDuplicates([SEQ, "label_track", "t"]), [SEQ, "label_track", "t"], "left")
    w = Window.partitionBy(SEQ, "label_track").orderBy("t")
    before = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = lambda c: F.first(c, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return every.withColumns({f"from_{i}": F.coalesce(before(f"center_{i}"), after(f"center_{i}")) for i in (0, 1)}).where("center_0 is null").select(SEQ, "label_track", "t", "from_0", "from_1")


def violations(tracks: DataFrame, pixels: DataFrame | None = None) -> DataFrame:
    """(sequence_id, rule, label): what breaks the rules of a valid lineage. C12.

    gaps; parent missing; not exactly two daughters; daughters begin apart; a daughter doesn't begin right after its
    parent; parent and daughter overlap; no pixel for a row (if pixels are given)."""
    span = tracks.groupBy(SEQ, "label_track").agg(F.min("t").alias("b"), F.max("t").alias("e"), F.countDistinct("t").alias("n"), F.max("parent_track").alias("parent"))
    child = span.where("parent > 0 and parent != label_track")
    up = child.select(SEQ, F.col("parent").alias("label_track"), F.col("label_track").alias("daughter"), F.col("b").alias("born"))
    joined = up.join(span.select(SEQ, "label_track", F.col("e").alias("end")), [SEQ, "label_track"], "left")
    stats = up.groupBy(SEQ, "label_track").agg(F.countDistinct("daughter").alias("k"), F.countDistinct("born").alias("s"))
    say = lambda df, rule: df.select(SEQ, F.lit(rule).alias("rule"), F.col("label_track").alias("label")).distinct()
    found = [
        say(span.where("n < e - b + 1"), "gap"), say(joined.where("end is null"), "parent missing"), say(stats.where("k != 2"), "daughters"), say(stats.where("s > 1"), "starts apart"),
        say(joined.where("born != end + 1"), "start after parent"), say(joined.where("born <= end"), "overlap"),
    ]
    if pixels is not None:
        there = pixels.where("label != 0").select(SEQ, "t", F.col("label").alias("label_track")).distinct()
        found.append(say(tracks.join(there, [SEQ, "t", "label_track"], "left_anti"), "no pixel"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def around(tracks: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """(sequence_id, inner, outer): trajectories that are there before and after another, but in none of its frames; of
    those that ``inner`` (sequence_id, label_track) names, if given.

    Each has a gap over the other's first frame, so pairs come from the frames of gaps."""
    span = _spans(tracks)
    asked = span if inner is None else span.join(inner.select(SEQ, F.col("label_track").alias("inner")), [SEQ, "inner"], "left_semi")
    met = _by_first_frame(_hole_frames(tracks).drop("to"), asked).where("inner != outer")
    met = met.join(span.select(SEQ, F.col("inner").alias("outer"), F.col("e").alias("_end")), [SEQ, "outer"]).where("_end > e").select(SEQ, "inner", "outer")
    at = tracks.select(SEQ, "label_track", "t")
    shared = met.join(at.withColumnRenamed("label_track", "inner"), [SEQ, "inner"]).join(at.withColumnRenamed("label_track", "outer"), [SEQ, "outer", "t"], "left_semi").select(SEQ, "inner", "outer").distinct()
    return met.join(shared, [SEQ, "inner", "outer"], "left_anti")


def removable_merges(tracks: DataFrame, preds: DataFrame, threshold: float, pixels: DataFrame | None = None, least_coverage: float = 0.5) -> DataFrame:
    """(sequence_id, label_track): merged masks that go, as the cells they cover are there before and after. C6.

    Such a trajectory lies inside a gap, has neither parent nor daughters, and no correspondence (p1) above the
    threshold leaves it for another. Of the trajectories around it, each has a correspondence above the threshold from
    its last row before to a first row after of one of them; or, where there are pixels, their masks in these rows
    together cover more than least_coverage of it in each of its frames."""
    free = gap_only(tracks)
    linked = tracks.where("parent_track > 0 and parent_track != label_track")
    kin = linked.select(SEQ, F.col("parent_track").alias("label_track")).union(linked.select(SEQ, "label_track")).distinct()
    free = free.join(kin, [SEQ, "label_track"], "left_anti")
    own = tracks.join(free, [SEQ, "label_track"], "left_semi").select(SEQ, "label_track", "index", "t")
    leaving = own.select(SEQ, "label_track", F.col("index").alias("src")).join(preds.where(F.col("p1") > threshold).select(SEQ, "src", "dst"), [SEQ, "src"])
    leaving = leaving.join(own.select(SEQ, "label_track", F.col("index").alias("dst")), [SEQ, "label_track", "dst"], "left_anti").select(SEQ, "label_track").distinct()
    free = free.join(leaving, [SEQ, "label_track"], "left_anti")
    # What is around a trajectory follows from its frames alone, so of those with the same frames one is asked for.
    frames = own.groupBy(SEQ, "label_track").agg(F.sort_array(F.collect_set("t")).alias("_frames"))
    frames = frames.join(free, [SEQ, "label_track"], "left_semi")
    first = frames.groupBy(SEQ, "_frames").agg(F.min("label_track").alias("inner"))
    same = _written(frames.join(first, [SEQ, "_frames"]).select(SEQ, "label_track", "inner", F.element_at("_frames", 1).alias("b"), F.element_at("_frames", -1).alias("e")), "free-merges")
    asked = same.where("label_track = inner").select(SEQ, "inner", "b", "e")
    near = around(tracks, asked.select(SEQ, F.col("inner").alias("label_track"))).join(asked, [SEQ, "inner"])
    # The rows next to it are those of the others' gaps over its first and its last frame.
    holes = gaps(tracks).select(SEQ, F.col("label_track").alias("outer"), "t", "index", "next_t", "next_index")
    over = lambda frame, names: holes.select(SEQ, "outer", F.col("t").alias(f"_t_{frame}"), F.col("next_t").alias(f"_next_{frame}"), F.col(names[0]).alias(f"{frame}_t"), F.col(names[1]).alias(f"{frame}_index"))
    ends = near.join(over("before", ("t", "index")), [SEQ, "outer"]).where("b > _t_before and b < _next_before")
    ends = ends.join(over("after", ("next_t", "next_index")), [SEQ, "outer"]).where("e > _t_after and e < _next_after")
    ends = _written(ends.select(SEQ, "inner", "outer", "before_t", "before_index", "after_t", "after_index"), "merge-ends")
    links = ends.select(SEQ, "inner", "outer", F.col("before_index").alias("src")).join(preds.where(F.col("p1") > threshold).select(SEQ, "src", "dst"), [SEQ, "src"])
    links = links.join(ends.select(SEQ, "inner", F.col("after_index").alias("dst")).distinct(), [SEQ, "inner", "dst"], "left_semi").select(SEQ, "inner", "outer").distinct()
    have = lambda df, name: df.groupBy(SEQ, "inner").agg(F.count(F.lit(1)).alias(name))
    found = have(ends, "_all").join(have(links, "_linked"), [SEQ, "inner"]).where("_all = _linked").select(SEQ, "inner")
    found = same.join(found, [SEQ, "inner"], "left_semi").select(SEQ, "label_track")
    if pixels is None:
        return found
    masks = pixels.where("label != 0").select(SEQ, "t", F.col("label").alias("outer"), "y", "x")
    sides = ends.select(SEQ, "inner", "outer", F.explode(F.array("before_t", "after_t")).alias("t"))
    cover = sides.join(masks, [SEQ, "outer", "t"]).select(SEQ, "inner", "y", "x").distinct().withColumn("_in", F.lit(1))
    mine = own.select(SEQ, "label_track", "t").join(same.select(SEQ, "label_track", "inner"), [SEQ, "label_track"]).join(masks.withColumnRenamed("outer", "label_track"), [SEQ, "label_track", "t"])
    share = mine.join(cover, [SEQ, "inner", "y", "x"], "left").groupBy(SEQ, "label_track", "t").agg((F.count("_in") / F.count(F.lit(1))).alias("_share"))
    covered = share.groupBy(SEQ, "label_track").agg(F.min("_share").alias("_least")).where(F.col("_least") > least_coverage).select(SEQ, "label_track")
    return found.union(covered).distinct()


def touching(tracks: DataFrame, pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (sequence_id, label_a, label_b) whose pixels are one 8-connected region in every frame that has any."""
    from trackweave.operators.pixels import connected_parts

    tracks, pixels = merged_in_joins(tracks, pixels)
    named = pairs.select(SEQ, "label_a", "label_b", F.explode(F.array("label_a", "label_b")).alias("label"))
    named = named.withColumn("_pair", F.xxhash64("label_a", "label_b"))
    frames = tracks.select(SEQ, F.col("label_track").alias("label"), "t").join(named, [SEQ, "label"]).select(SEQ, "_pair", "t").distinct().hint("merge")
    own = named.join(pixels.where("label != 0"), [SEQ, "label"]).join(frames, [SEQ, "_pair", "t"], "left_semi")
    parts = connected_parts(own.select(SEQ, "t", F.col("_pair").alias("label"), "y", "x"))
    apart = parts.where("part > 0").select(SEQ, F.col("label").alias("_pair")).distinct().hint("merge")
    return pairs.withColumn("_pair", F.xxhash64("label_a", "label_b")).join(apart, [SEQ, "_pair"], "left_anti").drop("_pair")


def early_divisions(tracks: DataFrame, pixels: DataFrame, preds: DataFrame, most: int = 5, threshold: float = 0.5, least_frames: int = 3, least_coverage: float = 0.5) -> DataFrame:
    """(sequence_id, parent, label, sibling, successor): divisions whose daughters become one cell again. C4.

    The daughter lives at most ``most`` frames, its sibling at least ``least_frames`` and longer than until the
    daughter's birth; neither divides again; they touch in every frame, and share none with their parent. The
    successor has no parent, begins in the frame after both have ended, and their last masks cover at least
    least_coverage of its first. If links lead to it from the last rows of parent or daughters, one must be above the
    threshold (p1, or p2 where p1 is nowhere above 0). A successor is taken once, by the least parent."""
    tracks, pixels, preds = merged_in_joins(tracks, pixels, preds)
    span = tracks.groupBy(SEQ, "label_track").agg(F.min("t").alias("b"), F.max("t").alias("e"), F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "index", "parent_track")).alias("f"), F.max(F.struct("t", "index")).alias("l"))
    span = span.select(SEQ, "label_track", "b", "e", "n", F.col("f.parent_track").alias("parent"), F.col("f.index").alias("first"), F.col("l.index").alias("last"))
    fertile = tracks.where("parent_track > 0").select(SEQ, F.col("parent_track").alias("label_track")).distinct()
    short = span.join(short_tracks(tracks, most, True).select(SEQ, "label_track").distinct(), [SEQ, "label_track"], "left_semi").where("parent > 0").join(fertile, [SEQ, "label_track"], "left_anti")
    other = span.where("parent > 0").select(SEQ, "parent", F.col("label_track").alias("sibling"), F.col("e").alias("s_e"), F.col("n").alias("s_n"), F.col("last").alias("s_last"))
    met = short.select(SEQ, "parent", F.col("label_track").alias("label"), "b", "e", "last").join(other, [SEQ, "parent"]).where("label != sibling")
    met = met.withColumn("_k", F.row_number().over(Window.partitionBy(SEQ, "label").orderBy("sibling"))).where("_k = 1").drop("_k")
    met = met.join(fertile.withColumnRenamed("label_track", "sibling"), [SEQ, "sibling"], "left_anti").where((F.col("s_e") > F.col("b")) & (F.col("s_n") >= least_frames))
    at = tracks.select(SEQ, "label_track", "t")
    pair = met.select(SEQ, "parent", "label", "sibling")
    theirs = pair.select(SEQ, "label", "sibling", "parent", F.explode(F.array("label", "sibling")).alias("label_track")).join(at, [SEQ, "label_track"]).select(SEQ, "label", "sibling", "parent", "t").distinct()
    clash = theirs.join(at.withColumnRenamed("label_track", "parent"), [SEQ, "parent", "t"], "left_semi").select(SEQ, "label", "sibling").distinct().hint("merge")
    met = met.join(clash, [SEQ, "label", "sibling"], "left_anti")
    met = touching(tracks, pixels, met.withColumnsRenamed({"label": "label_a", "sibling": "label_b"})).withColumnsRenamed({"label_a": "label", "label_b": "sibling"})
    # Covered first masks of cells that appear in the frame after both daughters have ended.
    masks = pixels.where("label != 0").select(SEQ, "t", F.col("label").alias("label_track"), "y", "x")
    sides = F.explode(F.array(F.struct(F.col("label").alias("label_track"), F.col("e").alias("t")), F.struct(F.col("sibling").alias("label_track"), F.col("s_e").alias("t")))).alias("m")
    union = met.select(SEQ, "label", "sibling", (F.greatest("e", "s_e") + 1).alias("born"), sides).select(SEQ, "label", "sibling", "born", "m.*")
    union = union.join(masks, [SEQ, "label_track", "t"]).select(SEQ, "label", "sibling", F.col("born").alias("t"), "y", "x").distinct()
    fresh = span.where("parent = 0").select(SEQ, "label_track", F.col("b").alias("t"), "first")
    first_masks = fresh.join(masks, [SEQ, "label_track", "t"])
    area = first_masks.groupBy(SEQ, "label_track").agg(F.count(F.lit(1)).alias("_area"))
    shared = union.join(first_masks, [SEQ, "t", "y", "x"]).where("label_track != label and label_track != sibling").groupBy(SEQ, "label", "sibling", F.col("label_track")).agg(F.count(F.lit(1)).alias("_n"))
    shared = shared.join(area, [SEQ, "label_track"]).where(F.col("_n") >= least_coverage * F.col("_area"))
    chosen = shared.groupBy(SEQ, "label", "sibling").agg(F.min("label_track").alias("successor")).hint("merge")
    found = met.join(chosen, [SEQ, "label", "sibling"]).join(fresh.select(SEQ, F.col("label_track").alias("successor"), F.col("first").alias("dst")), [SEQ, "successor"])
    found = found.join(span.select(SEQ, F.col("label_track").alias("parent"), F.col("last").alias("p_last")), [SEQ, "parent"], "left")
    score = preds.groupBy(SEQ).agg(F.max("p1").alias("_most")).select(SEQ, (F.col("_most") == 0).alias("_plain"))
    scored = preds.join(score, SEQ).select(SEQ, "src", "dst", F.when(F.col("_plain"), F.col("p2")).otherwise(F.col("p1")).alias("p"))
    given = found.select(SEQ, "label", "sibling", "dst", F.explode(F.array("last", "s_last", "p_last")).alias("src")).join(scored, [SEQ, "src", "dst"]).groupBy(SEQ, "label", "sibling").agg(F.max("p").alias("_p")).hint("merge")
    found = found.join(given, [SEQ, "label", "sibling"], "left").where(F.col("_p").isNull() | (F.col("_p") > threshold))
    once = Window.partitionBy(SEQ, "successor").orderBy("parent", "label")
    twin = Window.partitionBy(SEQ, "parent").orderBy("label")
    found = found.withColumn("_k", F.row_number().over(twin)).where("_k = 1").withColumn("_k", F.row_number().over(once)).where("_k = 1")
    return found.select(SEQ, "parent", "label", "sibling", "successor")


def merge_into_parents(tracks: DataFrame, divisions: DataFrame) -> DataFrame:
    """Daughters and successors of ``early_divisions`` become part of the parent's trajectory, with the parent's own
    parent; what was born of them is born of it. Their rows have cell_source merged. C4."""
    names = divisions.select(SEQ, F.explode(F.array("label", "sibling", "successor")).alias("old"), F.col("parent").alias("new"))
    # A parent that is itself merged into another one leads on to that.
    return _renamed(tracks, _resolved(names))


def _resolved(names: DataFrame) -> DataFrame:
    """(sequence_id, old, new) followed to its end."""
    from trackweave.operators.lineage import _written

    while True:
        on = names.select(SEQ, F.col("old").alias("new"), F.col("new").alias("_next"))
        stepped = _written(names.join(on, [SEQ, "new"], "left").select(SEQ, "old", "new", "_next"), "names")
        if stepped.where("_next is not null").isEmpty():
            return stepped.select(SEQ, "old", "new")
        names = stepped.select(SEQ, "old", F.coalesce("_next", "new").alias("new"))


def _renamed(tracks: DataFrame, names: DataFrame) -> DataFrame:
    own = names.select(SEQ, F.col("old").alias("label_track"), F.col("new").alias("_l"))
    up = names.select(SEQ, F.col("old").alias("parent_track"), F.col("new").alias("_p"))
    heads = tracks.groupBy(SEQ, F.col("label_track").alias("_l")).agg(F.max(F.when(F.col("parent_track") != F.col("label_track"), F.col("parent_track"))).alias("_pp"))
    heads = heads.join(names.select(SEQ, F.col("old").alias("_pp"), F.col("new").alias("_ppn")), [SEQ, "_pp"], "left").select(SEQ, "_l", F.coalesce("_ppn", "_pp", F.lit(0)).alias("_pp"))
    given = tracks.join(own, [SEQ, "label_track"], "left").join(up, [SEQ, "parent_track"], "left").join(heads, [SEQ, "_l"], "left")
    merged = F.col("_l").isNotNull()
    out = given.withColumns({
        "label_track": F.coalesce("_l", "label_track"), "parent_track": F.when(merged, F.col("_pp")).otherwise(F.coalesce("_p", "parent_track")),
        "cell_source": F.when(merged, F.lit("merged")).otherwise(F.col("cell_source")),
    })
    return out.select(*tracks.columns)


def merged_daughters(tracks: DataFrame, pixels: DataFrame, preds: DataFrame, threshold: float = 0.5, divides: float = 0.5, least_coverage: float = 0.5, most: int = 3) -> DataFrame:
    """Masks that cover two daughters at once, which are two cells again afterwards. C5.

    (sequence_id, parent, a, b, a_last, b_last, merged, t, after_a, after_b): a parent's two daughters, the smaller
    label first, that end in one frame, don't divide again and touch in every frame; the label that begins in the next
    frame t, lasts at most ``most`` frames, and of which they cover most; and the two targets of its first row with the
    largest p2. Either they cover least_coverage of it, or a link supports it: from the parent's last row into it (p1
    above threshold), from it to the two (p2 above divides), or from a daughter's last row to one of the two (p1). Of
    several pairs under one label the one of the least parent counts."""
    tracks, pixels, preds = merged_in_joins(tracks, pixels, preds)
    span = tracks.groupBy(SEQ, "label_track").agg(F.min("t").alias("b"), F.max("t").alias("e"), F.max(F.struct("t", "index")).alias("l"), F.min(F.struct("t", "index")).alias("f"))
    span = span.select(SEQ, "label_track", "b", "e", F.col("l.index").alias("last"), F.col("f.index").alias("first"))
    kids = tracks.where("parent_track > 0").select(SEQ, F.col("parent_track").alias("parent"), "label_track").distinct()
    pairs = kids.groupBy(SEQ, "parent").agg(F.count(F.lit(1)).alias("n"), F.min("label_track").alias("a"), F.max("label_track").alias("b")).where("n = 2").drop("n")
    fertile = kids.select(SEQ, F.col("parent").alias("x")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(fertile.withColumnRenamed("x", side), [SEQ, side], "left_anti")
        pairs = pairs.join(span.select(SEQ, F.col("label_track").alias(side), F.col("e").alias(f"e_{side}"), F.col("last").alias(f"{side}_last")), [SEQ, side])
    pairs = pairs.where("e_a = e_b").select(SEQ, "parent", "a", "b", "a_last", "b_last", (F.col("e_a") + 1).alias("t"))
    masks = pixels.where("label != 0").select(SEQ, "t", "y", "x", "label")
    under = pairs.select(SEQ, "parent", F.col("t"), F.explode(F.array("a", "b")).alias("label"), (F.col("t") - 1).alias("_t")).join(masks.withColumnRenamed("t", "_t"), [SEQ, "label", "_t"]).select(SEQ, "parent", "t", "y", "x").distinct()
    met = under.join(masks, [SEQ, "t", "y", "x"]).groupBy(SEQ, "parent", "t", "label").agg(F.count(F.lit(1)).alias("n"))
    met = met.join(pairs.select(SEQ, "parent", "a", "b"), [SEQ, "parent"]).where("label != a and label != b").drop("a", "b")
    area = masks.join(met.select(SEQ, "t", "label").distinct(), [SEQ, "t", "label"], "left_semi").groupBy(SEQ, "t", "label").agg(F.count(F.lit(1)).alias("area"))
    best = met.join(area, [SEQ, "t", "label"]).groupBy(SEQ, "parent").agg(F.max(F.struct((F.col("n") / F.col("area")).alias("coverage"), (-F.col("label")).alias("label"))).alias("x"))
    found = pairs.join(best.select(SEQ, "parent", (-F.col("x.label")).alias("merged"), F.col("x.coverage").alias("coverage")), [SEQ, "parent"])
    found = found.join(span.select(SEQ, F.col("label_track").alias("merged"), "b", "e", "first").withColumnsRenamed({"b": "m_b", "e": "m_e"}), [SEQ, "merged"])
    found = found.where((F.col("m_b") == F.col("t")) & (F.col("m_e") - F.col("t") < most))
    out = top_targets(preds.join(found.select(SEQ, F.col("first").alias("src")).distinct(), [SEQ, "src"], "left_semi"), 2)
    out = out.groupBy(SEQ, F.col("src").alias("first")).agg(F.max(F.when(F.col("rank") == 1, F.col("dst"))).alias("after_a"), F.max(F.when(F.col("rank") == 2, F.col("dst"))).alias("after_b"), F.max("p2").alias("p_out")).where("after_b is not null")
    found = found.join(out, [SEQ, "first"])
    found = found.join(span.select(SEQ, F.col("label_track").alias("parent"), F.col("last").alias("p_last")), [SEQ, "parent"], "left")
    ways = F.array(F.struct(F.col("p_last").alias("src"), F.col("first").alias("dst")), *(F.struct(F.col(s).alias("src"), F.col(d).alias("dst")) for s in ("a_last", "b_last") for d in ("after_a", "after_b")))
    score = found.select(SEQ, "parent", F.explode(ways).alias("w")).select(SEQ, "parent", "w.*").join(preds.select(SEQ, "src", "dst", "p1"), [SEQ, "src", "dst"]).groupBy(SEQ, "parent").agg(F.max("p1").alias("p_in"))
    found = found.join(score, [SEQ, "parent"], "left").where((F.col("coverage") >= least_coverage) | (F.col("p_out") > divides) | F.coalesce(F.col("p_in") > threshold, F.lit(False)))
    found = touching(tracks, pixels, found.withColumnsRenamed({"a": "label_a", "b": "label_b"})).withColumnsRenamed({"label_a": "a", "label_b": "b"})
    once = Window.partitionBy(SEQ, "merged").orderBy("parent")
    return found.withColumn("_k", F.row_number().over(once)).where("_k = 1").select(SEQ, "parent", "a", "b", "a_last", "b_last", "merged", "t", "after_a", "after_b")


def split_names(tracks: DataFrame, splits: DataFrame) -> DataFrame:
    """(sequence_id, merged, old, new, up, since): what follows a merge, as far as it comes from it, and the daughter
    whose trajectory it goes on. C7."""
    sides = F.explode(F.array(*(F.struct(F.col(f"after_{k}").alias("index"), F.col(k).alias("new")) for k in ("a", "b")))).alias("s")
    after = splits.select(SEQ, "merged", F.col("parent").alias("up"), sides).select(SEQ, "merged", "up", "s.*")
    return after.join(tracks.select(SEQ, "index", "t", F.col("label_track").alias("old"), "parent_track"), [SEQ, "index"]).where("parent_track = merged and old != new").select(SEQ, "merged", "old", "new", "up", F.col("t").alias("since"))


def split_erased(tracks: DataFrame, splits: DataFrame, names: DataFrame) -> DataFrame:
    """(sequence_id, t, label_track): the merged rows that go: the first, and those before what follows is named anew. C7."""
    until = names.groupBy(SEQ, "merged").agg(F.min("since").alias("until"))
    given = splits.select(SEQ, "merged", F.col("t").alias("from")).join(until, [SEQ, "merged"], "left")
    rows = tracks.select(SEQ, "t", "label_track").join(given.withColumnRenamed("merged", "label_track"), [SEQ, "label_track"])
    return rows.where((F.col("t") == F.col("from")) | (F.col("t") > F.col("from")) & (F.col("t") < F.col("until"))).select(SEQ, "t", "label_track").distinct()


def split_rows(tracks: DataFrame, splits: DataFrame) -> DataFrame:
    """The rows of the daughters that are drawn in the frame of the merge, half way to what carries them on; cell_source
    split. C7."""
    drawn = {k: F.col(f"draws_{k}") if f"draws_{k}" in splits.columns else F.lit(True) for k in ("a", "b")}
    sides = F.explode(F.filter(F.array(*(F.struct(F.col(k).alias("label_track"), F.col(f"{k}_last").alias("last"), F.col(f"after_{k}").alias("after"), drawn[k].alias("drawn")) for k in ("a", "b"))), lambda x: x["drawn"])).alias("s")
    at = lambda end: tracks.select(SEQ, F.col("index").alias(end), *(F.col(f"center_{i}").alias(f"{end}_{i}") for i in (0, 1)))
    rows = splits.select(SEQ, F.col("parent").alias("parent_track"), "t", sides).select(SEQ, "parent_track", "t", "s.*").join(at("last"), [SEQ, "last"]).join(at("after"), [SEQ, "after"], "left")
    rows = rows.select(SEQ, "label_track", "parent_track", "t", *((F.col(f"last_{i}") + F.coalesce(f"after_{i}", f"last_{i}")).alias(f"center_{i}") for i in (0, 1)), F.lit("split").alias("cell_source"))
    rows = rows.withColumns({f"center_{i}": F.col(f"center_{i}") / 2 for i in (0, 1)})
    top = tracks.groupBy(SEQ).agg(F.max("index").alias("_top"))
    return numbered(rows, "index", "label_track", "t").join(top, SEQ).withColumn("index", F.col("index") + F.col("_top")).drop("_top")


def split_order(splits: DataFrame, names: DataFrame) -> DataFrame:
    """The splits that are made, with draws_a and draws_b: whether each daughter still has its own mask then. C5.

    Splits are made in the order of their frames. One that renames what follows a merge takes the masks of that name, so
    a later split of the same cells has nothing left to draw: it isn't made if both its daughters were renamed, and draws
    one if one was. A split waits for at most two earlier ones, so runs of merges are settled from their first on, all
    runs at once; each round is written."""
    before = names.select(SEQ, F.col("merged").alias("_by"), "old")
    s = splits
    for side in ("a", "b"):
        s = s.join(before.withColumnsRenamed({"old": side, "_by": f"_by_{side}"}), [SEQ, side], "left")
    waiting = _written(s, "splits-waiting")
    settled = None
    while settled is None or not waiting.isEmpty():
        ready = waiting
        for side in ("a", "b"):
            if settled is None:
                ready = ready.where(F.col(f"_by_{side}").isNull()).withColumn(f"_{side}", F.lit(None).cast("boolean"))
            else:
                known = settled.select(SEQ, F.col("merged").alias(f"_by_{side}"), F.col("made").alias(f"_{side}"))
                ready = ready.join(known, [SEQ, f"_by_{side}"], "left").where(f"_by_{side} is null or _{side} is not null")
        ready = ready.withColumns({f"draws_{side}": ~F.coalesce(f"_{side}", F.lit(False)) for side in ("a", "b")}).withColumn("made", F.col("draws_a") | F.col("draws_b"))
        ready = _written(ready.select(*splits.columns, "draws_a", "draws_b", "made"), "splits-settled")
        if ready.isEmpty() and settled is not None:
            break
        settled = ready if settled is None else settled.union(ready)
        waiting = _written(waiting.join(settled.select(SEQ, "merged"), [SEQ, "merged"], "left_anti"), "splits-waiting")
    return settled.where("made").drop("made")
