"""The chain of repairs: stages over a state of tracks, pixels and predictions."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators import correction as c
from trackweave.operators import gap_repair
from trackweave.operators.lineage import _written
from trackweave.operators.progress import Cancelled, Progress
from trackweave.storage import NoSharedFolder

SEQ = "sequence_id"
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class State:
    """tracks, pixels by trajectory label, and scored links; every stage returns a new one.

    What the chain as a whole returns says besides what it has not done: uncorrected are (sequence_id, rule, n) of the
    sequences that kept what was given, failed is the repair that failed and why, after which all kept it."""

    tracks: DataFrame
    pixels: DataFrame
    preds: DataFrame
    uncorrected: DataFrame | None = None
    failed: str | None = None


Stage = Callable[[State], State]


def gap_masks(state: State, most: int | None = None) -> DataFrame:
    """The pixels that fill gaps: the last mask before the gap in each missing frame. C2, C16."""
    holes = c.gaps(state.tracks, most).select(SEQ, F.col("label_track").alias("label"), "t", "next_t")
    last = state.pixels.where("label != 0").join(holes, [SEQ, "label", "t"])
    return last.withColumn("at", F.explode(F.sequence(F.col("t") + 1, F.col("next_t") - 1))).select(SEQ, F.col("at").alias("t"), "y", "x", "label")


def conflicts(state: State, most: int | None = None, threshold: float = 0.5) -> DataFrame:
    """(sequence_id, t, label): missing frames where another label covers the copied mask, or is covered by it, above
    the threshold. C2, A17."""
    foot = gap_masks(state, most).withColumnRenamed("label", "owner")
    under = c.coverage(state.pixels, foot).where(F.greatest("coverage", "iou") > threshold)
    return under.select(SEQ, "t", F.col("owner").alias("label")).distinct()


def close_gaps(most: int | None = 2, threshold: float = 0.1, resolve: bool = False, link: float = 0.5, covered: float = 0.8, fragment: float = 0.1, images: DataFrame | None = None, detection: float = 0.0, frames: DataFrame | None = None) -> Stage:
    """Missing frames of gaps that aren't wider than ``most`` get a row and the last mask before the gap. Frames in which
    another mask is in the way stay open, or are resolved as gap_repair says. With images, only gaps whose copy looks
    like a detection are closed. C2."""

    def run(state: State) -> State:
        found = gap_repair.detection_gaps(state.tracks, most)
        if images is not None:
            found = gap_repair.supported(images, state.pixels, found, detection)
        return gap_repair.repaired(state, found, gap_repair.Rules(threshold, link, covered, fragment, resolve), frames)

    return run


def drop_orphans(state: State) -> State:
    return replace(state, tracks=c.drop_orphans(state.tracks, state.pixels))


def split_leftover_gaps(state: State) -> State:
    """Tracks are cut at their remaining gaps; pixels of the later pieces follow. C11."""
    cut = c.split_at_gaps(state.tracks)
    names = state.tracks.select(SEQ, "index", F.col("label_track").alias("label"), "t").join(cut.select(SEQ, "index", "label_track"), [SEQ, "index"]).select(SEQ, "t", "label", "label_track")
    pixels = state.pixels.join(names, [SEQ, "t", "label"], "left").withColumn("label", F.coalesce("label_track", "label")).select(*state.pixels.columns)
    return replace(state, tracks=cut, pixels=pixels)


def merge_early_divisions(most: int = 5, threshold: float = 0.5) -> Stage:
    """Daughters that become one cell again go back into their parent, with that cell; pixels follow. C4."""

    def run(state: State) -> State:
        found = _written(c.early_divisions(state.tracks, state.pixels, state.preds, most, threshold), "early")
        names = c._resolved(found.select(SEQ, F.explode(F.array("label", "sibling", "successor")).alias("old"), F.col("parent").alias("new")))
        named = names.select(SEQ, F.col("old").alias("label"), F.col("new").alias("_new"))
        pixels = state.pixels.join(named, [SEQ, "label"], "left").withColumn("label", F.coalesce("_new", "label")).select(*state.pixels.columns)
        return replace(state, tracks=c._renamed(state.tracks, names), pixels=pixels)

    return run


def remove_merges(threshold: float = 0.5, least_coverage: float = 0.5) -> Stage:
    """Merged masks inside the gaps of the cells they cover go, rows and pixels. C6."""

    def run(state: State) -> State:
        gone = _written(c.removable_merges(state.tracks, state.preds, threshold, state.pixels, least_coverage), "merges")
        rows = state.tracks.join(gone, [SEQ, "label_track"], "left_semi").select(SEQ, "t", "label_track")
        erased = rows.select(SEQ, "t", F.col("label_track").alias("label"), F.lit(True).alias("_gone")).distinct()
        pixels = state.pixels.join(erased, [SEQ, "t", "label"], "left").withColumn("label", F.when(F.col("_gone"), F.lit(0)).otherwise(F.col("label"))).select(*state.pixels.columns)
        return replace(state, tracks=c.remove_rows(state.tracks, rows, True), pixels=pixels)

    return run


def _drawn(pixels: DataFrame, masks: DataFrame, over: bool) -> DataFrame:
    """Pixels with masks (sequence_id, t, y, x, label) drawn in, over what is there or onto background alone."""
    onto = masks.groupBy(SEQ, "t", "y", "x").agg(F.min("label").alias("_new"))
    there = F.coalesce("label", F.lit(0))
    label = F.coalesce("_new", there) if over else F.when(there == 0, F.coalesce("_new", F.lit(0))).otherwise(there)
    return pixels.join(onto, [SEQ, "t", "y", "x"], "full").withColumn("label", label).select(*pixels.columns)


def split_merged_daughters(threshold: float = 0.5, divides: float = 0.5, least_coverage: float = 0.5, most: int = 3) -> Stage:
    """A mask over two daughters goes, they are drawn back in, and what follows it goes on under their labels; where
    merges follow each other, in the order of time. C5, C7."""

    def run(state: State) -> State:
        state = replace(state, **dict(zip(("tracks", "pixels", "preds"), c.merged_in_joins(state.tracks, state.pixels, state.preds), strict=True)))
        splits = _written(c.merged_daughters(state.tracks, state.pixels, state.preds, threshold, divides, least_coverage, most), "splits")
        names = _written(c.split_names(state.tracks, splits), "split-names")
        splits = _written(c.split_order(splits, names), "splits-made")
        names = _written(names.join(splits.select(SEQ, "merged"), [SEQ, "merged"], "left_semi"), "split-names")
        erased = _written(c.split_erased(state.tracks, splits, names), "split-erased")
        gone = erased.select(SEQ, "t", F.col("label_track").alias("label"), F.lit(True).alias("_gone"))
        own = names.select(SEQ, F.col("old").alias("label"), F.col("new").alias("_l"), "up", "since")
        pixels = state.pixels.join(gone, [SEQ, "t", "label"], "left").join(own, [SEQ, "label"], "left")
        later = F.coalesce(F.col("t") >= F.col("since"), F.lit(False))
        pixels = pixels.withColumn("label", F.when(F.col("_gone"), F.lit(0)).when(later, F.col("_l")).otherwise(F.col("label"))).select(*state.pixels.columns)
        drawn = F.filter(F.array(F.when(F.col("draws_a"), F.col("a")), F.when(F.col("draws_b"), F.col("b"))), lambda x: x.isNotNull())
        sides = splits.select(SEQ, F.explode(drawn).alias("label"), (F.col("t") - 1).alias("t"), F.col("t").alias("_t"))
        drawn = state.pixels.join(sides, [SEQ, "label", "t"]).select(SEQ, F.col("_t").alias("t"), "y", "x", "label")
        pixels = _drawn(pixels, drawn, over=True)
        tracks = state.tracks.join(erased, [SEQ, "t", "label_track"], "left_anti").join(own.withColumnRenamed("label", "label_track"), [SEQ, "label_track"], "left")
        up = names.select(SEQ, F.col("old").alias("parent_track"), F.col("new").alias("_p"))
        tracks = tracks.join(up, [SEQ, "parent_track"], "left")
        tracks = tracks.withColumns({"label_track": F.when(later, F.col("_l")).otherwise(F.col("label_track")), "parent_track": F.when(later, F.col("up")).otherwise(F.coalesce("_p", "parent_track"))}).select(*state.tracks.columns)
        tracks = tracks.unionByName(c.split_rows(state.tracks, splits), allowMissingColumns=True)
        whole = splits.select(SEQ, F.col("merged").alias("parent_track")).join(tracks.select(SEQ, F.col("label_track").alias("parent_track")), [SEQ, "parent_track"], "left_anti").withColumn("_none", F.lit(True))
        tracks = tracks.join(whole.distinct(), [SEQ, "parent_track"], "left").withColumn("parent_track", F.when(F.col("_none"), F.lit(0)).otherwise(F.col("parent_track"))).select(*state.tracks.columns)
        return replace(state, tracks=tracks, pixels=pixels)

    return run


def close_division_gaps(threshold: float = 0.1, images: DataFrame | None = None, detection: float = 0.0, frames: DataFrame | None = None) -> Stage:
    """Parents go on to the frame before their first daughters, with their last mask, or a marker where another mask is
    in the way. With images, daughters of a parent whose gap shows no detection lose it. C3."""

    def run(state: State) -> State:
        found = gap_repair.division_gaps(state.tracks)
        if images is not None:
            good = _written(gap_repair.supported(images, state.pixels, found, detection), "division-gaps")
            lost = found.join(good, [SEQ, "label"], "left_anti").select(SEQ, F.col("label").alias("parent_track"), F.lit(True).alias("_lost"))
            tracks = state.tracks.join(lost, [SEQ, "parent_track"], "left").withColumn("parent_track", F.when(F.col("_lost"), F.lit(0)).otherwise(F.col("parent_track"))).select(*state.tracks.columns)
            state, found = replace(state, tracks=_written(tracks, "division-tracks")), good
        return gap_repair.repaired(state, found, gap_repair.Rules(threshold, rename=False), frames)

    return run


class InvalidLineage(ValueError):
    """What the chain of repairs has left breaks the rules of a lineage."""


def validated(state: State) -> State:
    """The state, if no rule is broken; else an error that names rules and labels. C12."""
    left = c.violations(state.tracks, state.pixels).orderBy(SEQ, "rule", "label").limit(20).collect()
    if left:
        raise InvalidLineage("; ".join(f"{r[SEQ]}: {r['rule']} ({r['label']})" for r in left))
    return state


def default_stages() -> list[Stage]:
    """Close gaps that nothing contends for, merge early divisions, split and remove merges, close what that opened and
    resolve what contends, gaps before divisions as well, drop rows without a mask, cut what is still open."""
    return [close_gaps(), merge_early_divisions(), split_merged_daughters(), remove_merges(), close_gaps(resolve=True), close_division_gaps(), drop_orphans, split_leftover_gaps]


def valid_or_given(given: State, made: State) -> State:
    """Of each sequence what was made of it, if that breaks no rule of a lineage, else what was given. C1, C12."""
    left = _written(c.violations(made.tracks, made.pixels), "violations")
    broken = left.groupBy(SEQ, "rule").agg(F.count(F.lit(1)).alias("n"))
    bad = left.select(SEQ).distinct()
    for r in broken.orderBy(SEQ, "rule").limit(20).collect():
        log.warning("the repairs of %s break a rule, its tracks stay uncorrected: %s (%d labels)", r[SEQ], r["rule"], r["n"])
    both = lambda new, old: new.join(bad, SEQ, "left_anti").select(*old.columns).unionByName(old.join(bad, SEQ, "left_semi").select(*old.columns))
    return replace(made, tracks=both(made.tracks, given.tracks), pixels=both(made.pixels, given.pixels), uncorrected=broken)


def correct(state: State, stages: list[Stage] | None = None, progress: Progress | None = None, strict: bool = False) -> State:
    """All stages in order; each result is written before the next. Sequences whose result breaks a rule of a lineage
    keep what was given; the state names them. If a stage fails, the whole state is what it was before the first, and none
    of the later ones runs; the state says so, or, if strict, the error is raised. C1, C15. An error of the cluster itself,
    or of a session without a shared folder, is not caught. progress: told of each stage; what it cancels ends with
    Cancelled."""
    from pyspark.errors import PySparkException

    given, stages = state, stages if stages is not None else default_stages()
    progress = progress or Progress()
    for k, stage in enumerate(stages):
        name = getattr(stage, "__qualname__", str(stage)).split(".")[0]
        try:
            with progress.stage(state.tracks.sparkSession, name, k, len(stages)):
                made = stage(state)
                state = replace(made, tracks=_written(made.tracks, "tracks"), pixels=_written(made.pixels, "pixels"))
        except (Cancelled, NoSharedFolder):
            raise
        except (PySparkException, ValueError, TypeError, ArithmeticError, LookupError, RuntimeError, AssertionError) as why:
            if strict:
                raise
            log.warning("the repair %s failed, the tracks stay uncorrected: %s", name, why)
            return replace(given, failed=f"{name}: {why}")
    return valid_or_given(given, state)


def detection_quality(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Objects of the truth, of the result, and matches in which more than half of a true mask is covered, by
    sequence. A23: the detection part of a tracking score."""
    area = truth.where("label != 0").groupBy(SEQ, "t", "label").agg(F.count(F.lit(1)).alias("_a"))
    have = found.where("label != 0").select(SEQ, "t", "label").distinct().groupBy(SEQ).agg(F.count(F.lit(1)).alias("objects_found"))
    other = found.where("label != 0").select(SEQ, "t", "y", "x", F.col("label").alias("found"))
    met = truth.where("label != 0").join(other, [SEQ, "t", "y", "x"]).groupBy(SEQ, "t", "label", "found").agg(F.count(F.lit(1)).alias("_n"))
    good = met.join(area, [SEQ, "t", "label"]).where("2 * _n > _a").groupBy(SEQ).agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("t", "found").alias("found_matched"))
    total = area.groupBy(SEQ).agg(F.count(F.lit(1)).alias("objects_true"))
    out = total.join(have, SEQ, "full").join(good, SEQ, "left")
    return out.select(SEQ, *(F.coalesce(x, F.lit(0)).alias(x) for x in ("objects_true", "objects_found", "matches", "found_matched")))
