"""Closing gaps where other masks are in the way: gaps that contend are folded together, in order. C2, C3.

The last mask before a gap is copied into each of its frames. What a copy meets there, what it may remove, rename or
draw over, and what other copies do at the same places, can decide another gap's outcome. So gaps are joined with the
cells (a label in a frame) that they read or write, with the brief trajectories that they may take away, and with copies
that share pixels; each connected component is folded by itself, its gaps by label and frame. Everything else is joins.

Outcomes for a mask that a copy overlaps by more than a threshold, if it lies within the gap and has neither parent nor
daughters: it is *relabelled* if its strongest link leads to the cell behind the gap; else, if no strong link leads
away from it, *removed* if the copy covers most of it, or *drawn over* if it stays in one piece. If none applies, the
frame gets a *marker* of one pixel on the nearest background. Markers are placed when all copies are drawn, so none is
lost under a copy.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators import correction as c
from trackweave.operators.components import components
from trackweave.operators.lineage import _written
from trackweave.operators.markers import frames_of, placed_markers
from trackweave.operators.numbering import numbered

if TYPE_CHECKING:
    from trackweave.operators.chain import State

SEQ = "sequence_id"
NEIGHBOURS = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)


@dataclass(frozen=True)
class Rules:
    """overlap: the larger of IoU and coverage above which a mask is in the way; link: the score above which a link is
    strong; covered: the coverage above which a mask goes rather than is drawn over; fragment: the part of a mask that
    may be split off. resolve: False leaves frames with conflicts open; rename: False allows markers alone."""

    overlap: float = 0.1
    link: float = 0.5
    covered: float = 0.8
    fragment: float = 0.1
    resolve: bool = True
    rename: bool = True


def pieces(points: set[tuple[int, int]]) -> list[set[tuple[int, int]]]:
    """The 8-connected parts of a set of pixels, in the order of their first pixel."""
    left, found = set(points), []
    for start in sorted(points):
        if start not in left:
            continue
        part, stack = set(), [start]
        left.discard(start)
        while stack:
            y, x = stack.pop()
            part.add((y, x))
            near = [(y + dy, x + dx) for dy, dx in NEIGHBOURS if (y + dy, x + dx) in left]
            left.difference_update(near)
            stack += near
        found.append(part)
    return found


class Scene:
    """The masks of one component while its gaps are folded."""

    def __init__(self) -> None:
        self.owner: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
        self.cells: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        self.frames: dict[int, set[int]] = defaultdict(set)  # of each label
        self.changed: set[tuple[int, int, int]] = set()

    def put(self, t: int, points, label: int, log: bool = True) -> None:
        for p in points:
            before = self.owner[t].get(p, 0)
            if before:
                self.cells[t, before].discard(p)
            self.owner[t][p] = label
            if label:
                self.cells[t, label].add(p)
                self.frames[label].add(t)
            if log and before != label:
                self.changed.add((t, *p))

    def rename(self, label: int, new: int) -> None:
        for t in sorted(self.frames[label]):
            self.put(t, list(self.cells[t, label]), new)


def fold(gaps: list[dict], scene: Scene, facts: dict[int, dict], answers: dict[tuple[int, int, int], float], rules: Rules) -> list[tuple]:
    """Rows (kind, t, label, new): copy and marker for a filled frame, relabel and remove for a trajectory.

    facts: of a label first and last frame, lone (neither parent nor daughters), best (its strongest link) and strong (a
    strong link leads away); answers: the strongest link from a label to the cell behind a gap (label, its frame)."""
    out: list[tuple] = []

    def place(t: int, copy: set, label: int) -> None:
        scene.put(t, max(pieces(copy), key=len), label)
        out.append(("copy", t, label, None))

    def resolved(gap: dict, t: int, copy: set, met: Counter, against: list[int]) -> bool:
        label, begin, end = gap["label"], gap["t"] + 1, gap["next_t"] - 1
        for other in against:
            f = facts.get(other)
            if f is None or not f["lone"] or f["first"] < begin or f["last"] > end:
                continue
            to_next = answers.get((label, gap["t"], other), 0.0)
            if to_next > rules.link and to_next >= f["best"]:
                scene.rename(other, label)
                out.append(("relabel", None, other, label))
                return True
            coverage = met[other] / len(scene.cells[t, other])
            if f["strong"]:
                continue
            if coverage > rules.covered:
                scene.rename(other, 0)
                out.append(("remove", None, other, None))
                place(t, copy, label)
                return True
            if coverage > rules.overlap:
                sizes = [len(p) for p in pieces(scene.cells[t, other] - copy)]
                if len(sizes) > 1 and min(sizes) / sum(sizes) > rules.fragment:
                    continue
                place(t, copy, label)
                return True
        return False

    for gap in gaps:
        label = gap["label"]
        for t in range(gap["t"] + 1, gap["next_t"]):
            copy = set(scene.cells.get((gap["t"], label), ()))
            if scene.cells.get((t, label)) or not copy:
                continue
            met = Counter(o for p in copy if (o := scene.owner[t].get(p, 0)))
            size = {o: len(scene.cells[t, o]) for o in met}
            against = sorted(o for o, n in met.items() if max(n / size[o], n / (len(copy) + size[o] - n)) > rules.overlap)
            if not against:
                place(t, copy, label)
            elif rules.resolve and not (rules.rename and resolved(gap, t, copy, met, against)):
                out.append(("marker", t, label, None))
    return out


FOLDED = "kind string, t int, label long, new long, y int, x int"


#: What a row says where its kind has nothing to say: whole numbers stay whole in pandas.
UNSAID = {"next_t": ("int", 0), "y": ("int", 0), "x": ("int", 0), "other": ("long", 0), "score": ("double", 0.0), "lone": ("boolean", False), "strong": ("boolean", False)}


def _folded(pdf: pd.DataFrame, rules: Rules) -> pd.DataFrame:
    """The rows of fold() for whole components, one behind the other."""
    ends = (pdf["component"].ne(pdf["component"].shift(-1)) | pdf[SEQ].ne(pdf[SEQ].shift(-1))).to_numpy().nonzero()[0] + 1
    names = ("kind", "label", "t", "next_t", "y", "x", "other", "score", "lone", "strong")
    given, sequences, begin, rows = list(zip(*(pdf[k].tolist() for k in names), strict=True)), pdf[SEQ].tolist(), 0, []
    for end in ends.tolist():
        scene, gaps, facts, answers = Scene(), [], {}, {}
        for kind, label, t, next_t, y, x, other, score, lone, strong in given[begin:end]:
            if kind == "pixel":
                scene.put(t, ((y, x),), label, log=False)
            elif kind == "gap":
                gaps.append({"label": label, "t": t, "next_t": next_t})
            elif kind == "fact":
                facts[label] = {"first": t, "last": next_t, "lone": lone, "best": score, "strong": strong}
            else:
                answers[label, t, other] = score
        gaps.sort(key=lambda g: (g["label"], g["t"]))
        rows += [(*r, None, None, sequences[begin]) for r in fold(gaps, scene, facts, answers, rules)]
        rows += [("pixel", t, scene.owner[t][y, x], None, y, x, sequences[begin]) for t, y, x in sorted(scene.changed)]
        begin = end
    return pd.DataFrame(rows, columns=["kind", "t", "label", "new", "y", "x", SEQ]).astype({"t": "Int32", "label": "Int64", "new": "Int64", "y": "Int32", "x": "Int32"})


def _fold_rows(rules: Rules):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            # The last component may go on in the next batch.
            later = (pdf["component"] == pdf["component"].iloc[-1]) & (pdf[SEQ] == pdf[SEQ].iloc[-1])
            goes_on = bool(held) and held[0]["component"].iloc[0] == pdf["component"].iloc[-1] and held[0][SEQ].iloc[0] == pdf[SEQ].iloc[-1]
            if goes_on:
                held.append(pdf)
                continue
            whole = pd.concat([*held, pdf[~later]])
            held = [pdf[later]]
            if len(whole):
                yield _folded(whole, rules)
        if held:
            yield _folded(pd.concat(held), rules)

    return run


def contended(state: State, found: DataFrame, rules: Rules) -> DataFrame:
    """(sequence_id, kind, t, label, new, y, x): what fold() says for the gaps ``found`` (sequence_id, label, t, next_t,
    next_index), and the pixels that change."""
    gaps = _written(found.select(SEQ, "label", "t", "next_t", "next_index", F.xxhash64(F.lit("gap"), "label", "t").alias("gap")), "repair-gaps")
    pixels = state.pixels.where("label != 0")
    cell = lambda label, t: F.xxhash64(F.lit("cell"), label, t)
    frames = gaps.withColumn("at", F.explode(F.sequence(F.col("t") + 1, F.col("next_t") - 1)))
    copies = _written(pixels.join(gaps.select(SEQ, "label", "t", "next_t", "gap"), [SEQ, "label", "t"]).withColumn("at", F.explode(F.sequence(F.col("t") + 1, F.col("next_t") - 1))).select(SEQ, "gap", F.col("at").alias("t"), "y", "x"), "repair-copies")
    under = copies.join(pixels, [SEQ, "t", "y", "x"]).select(SEQ, "gap", "label", "t").distinct()
    under = _written(under, "repair-under")
    # Trajectories that a gap may take away whole: brief ones without parent and daughters.
    spans = state.tracks.groupBy(SEQ, F.col("label_track").alias("label")).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max("parent_track").alias("parent"))
    parents = state.tracks.where("parent_track > 0").select(SEQ, F.col("parent_track").alias("label")).distinct()
    widest = gaps.groupBy(SEQ).agg(F.max(F.col("next_t") - F.col("t") - 1).alias("_w"))
    brief = spans.where("parent <= 0").join(widest, SEQ).where("last - first < _w").drop("_w").join(parents, [SEQ, "label"], "left_anti")
    brief = _written(brief.join(under.select(SEQ, "label").distinct(), [SEQ, "label"], "left_semi"), "repair-brief")
    own = frames.select(SEQ, "gap", "label", F.col("at").alias("t")).union(gaps.select(SEQ, "gap", "label", "t"))
    reads = own.union(under.select(SEQ, "gap", "label", "t"))
    takes = reads.join(brief.select(SEQ, "label"), [SEQ, "label"], "left_semi").select(SEQ, "gap", "label").distinct()
    held = takes.join(pixels.select(SEQ, "label", "t").distinct(), [SEQ, "label"]).select(SEQ, "gap", "label", "t")
    reads = _written(reads.union(held).distinct(), "repair-reads")
    shared = copies.groupBy(SEQ, "t", "y", "x").agg(F.min("gap").alias("first"), F.max("gap").alias("last")).where("first != last")
    meets = copies.join(shared.select(SEQ, "t", "y", "x", "first"), [SEQ, "t", "y", "x"]).where("gap != first").select(SEQ, F.col("gap").alias("src"), F.col("first").alias("dst")).distinct()
    links = reads.select(SEQ, F.col("gap").alias("src"), cell(F.col("label"), F.col("t")).alias("dst")).union(meets)
    groups = components(links)
    of_gap = groups.select(SEQ, F.col("index").alias("gap"), "component")
    parts = _written(reads.join(of_gap, [SEQ, "gap"]).select(SEQ, "component", "label", "t").distinct(), "repair-cells")
    rows = gaps.join(of_gap, [SEQ, "gap"]).select(SEQ, "component", F.lit("gap").alias("kind"), "label", "t", "next_t")
    rows = rows.unionByName(parts.join(pixels, [SEQ, "label", "t"]).select(SEQ, "component", F.lit("pixel").alias("kind"), "label", "t", "y", "x"), allowMissingColumns=True)
    if rules.resolve and rules.rename:
        members = state.tracks.join(brief.select(SEQ, F.col("label").alias("label_track")), [SEQ, "label_track"], "left_semi").select(SEQ, F.col("label_track").alias("group"), "index")
        out = state.preds.join(members.withColumnRenamed("index", "src"), [SEQ, "src"]).select(SEQ, F.col("group").alias("label"), "dst", "p1")
        best = out.groupBy(SEQ, "label").agg(F.max("p1").alias("score"))
        strong = c.strong_external(state.preds, members, rules.link).select(SEQ, F.col("group").alias("label"), F.lit(True).alias("strong"))
        facts = brief.join(best, [SEQ, "label"], "left").join(strong, [SEQ, "label"], "left").join(parts.select(SEQ, "component", "label").distinct(), [SEQ, "label"])
        rows = rows.unionByName(facts.select(SEQ, "component", F.lit("fact").alias("kind"), "label", F.col("first").alias("t"), F.col("last").alias("next_t"), F.lit(True).alias("lone"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("strong", F.lit(False)).alias("strong")), allowMissingColumns=True)
        met = takes.withColumnRenamed("label", "other").join(gaps.select(SEQ, "gap", "label", "t", "next_index"), [SEQ, "gap"])
        answers = met.join(out.select(SEQ, F.col("label").alias("other"), F.col("dst").alias("next_index"), "p1"), [SEQ, "other", "next_index"]).groupBy(SEQ, "gap", "label", "t", "other").agg(F.max("p1").alias("score"))
        rows = rows.unionByName(answers.join(of_gap, [SEQ, "gap"]).select(SEQ, "component", F.lit("answer").alias("kind"), "label", "t", "other", "score"), allowMissingColumns=True)
    said = [F.coalesce(F.col(k) if k in rows.columns else F.lit(None), F.lit(value)).cast(kind).alias(k) for k, (kind, value) in UNSAID.items()]
    rows = rows.select(SEQ, "component", "kind", "label", "t", *said)
    # Components may be many and small: a task takes those dealt to it one after the other and holds one at a time.
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), SEQ, "component").sortWithinPartitions(SEQ, "component")
    return dealt.mapInPandas(_fold_rows(rules), f"{FOLDED}, {SEQ} string")


def repaired(state: State, found: DataFrame, rules: Rules, frames: DataFrame | None = None) -> State:
    """The state with the gaps ``found`` (sequence_id, label, t, next_t, next_index, center_0, center_1, next_center_0,
    next_center_1) closed as far as ``rules`` allow. New rows are numbered on from the sequence's largest index, by label
    and frame; their positions lie on the line between the two ends. frames: (sequence_id, t, height, width), in which
    markers find background; by default they just hold the pixels there are."""
    found = _written(found, "repair-found")
    made = _written(contended(state, found, rules), "repair-made")
    edits = made.where("kind = 'pixel'").select(SEQ, "t", "y", "x", F.col("label").alias("_new"))
    pixels = state.pixels.join(edits, [SEQ, "t", "y", "x"], "full").withColumn("label", F.coalesce("_new", "label")).select(*state.pixels.columns)
    names = made.where("kind = 'relabel'").select(SEQ, F.col("label").alias("old"), "new")
    gone = made.where("kind = 'remove'").select(SEQ, F.col("label").alias("label_track")).distinct()
    removed = state.tracks.join(gone, [SEQ, "label_track"], "left_semi").select(SEQ, "t", "label_track")
    tracks = c.relabel(c.remove_rows(state.tracks, removed, clear_parents=True), names.groupBy(SEQ, "old").agg(F.min("new").alias("new")))
    ends = found.select(SEQ, F.col("label").alias("label_track"), F.col("t").alias("_t"), "next_t", "center_0", "center_1", "next_center_0", "next_center_1")
    part = (F.col("t") - F.col("_t")) / (F.col("next_t") - F.col("_t"))
    at = [(F.col(f"center_{i}") + (F.col(f"next_center_{i}") - F.col(f"center_{i}")) * part).alias(f"center_{i}") for i in (0, 1)]
    filled = made.where("kind in ('copy', 'marker')").select(SEQ, F.col("label").alias("label_track"), "t", "kind")
    filled = filled.join(ends, [SEQ, "label_track"]).where("t > _t and t < next_t").select(SEQ, "label_track", "t", "kind", *at)
    markers = filled.where("kind = 'marker'").select(SEQ, "t", F.col("label_track").alias("id"), F.col("center_0").alias("cy"), F.col("center_1").alias("cx"))
    if rules.resolve and not markers.isEmpty():
        pixels = _written(pixels, "repair-pixels")
        dots = _written(placed_markers(pixels, frames if frames is not None else frames_of(state.pixels), markers), "repair-markers")
        pixels = pixels.join(dots.withColumnRenamed("id", "_id"), [SEQ, "t", "y", "x"], "full").withColumn("label", F.coalesce("_id", "label")).select(*state.pixels.columns)
        found_spot = dots.select(SEQ, "t", F.col("id").alias("label_track"))
        filled = filled.where("kind = 'copy'").unionByName(filled.where("kind = 'marker'").join(found_spot, [SEQ, "t", "label_track"], "left_semi").select(*filled.columns))
    source = F.when(F.col("kind") == "copy", "interpolated").otherwise("interpolated_marker")
    top = state.tracks.groupBy(SEQ).agg(F.max("index").alias("_top"))
    parents = state.tracks.groupBy(SEQ, "label_track").agg(F.max("parent_track").alias("parent_track"))
    rows = numbered(filled, "index", "label_track", "t").join(top, SEQ).join(parents, [SEQ, "label_track"])
    rows = rows.select(SEQ, (F.col("index") + F.col("_top")).alias("index"), "t", "label_track", "parent_track", "center_0", "center_1", source.alias("cell_source"))
    return replace(state, tracks=tracks.unionByName(rows, allowMissingColumns=True), pixels=pixels)


def detection_gaps(tracks: DataFrame, most: int | None) -> DataFrame:
    """The gaps within trajectories as repaired() wants them."""
    return c.gaps(tracks, most).withColumnRenamed("label_track", "label")


def division_gaps(tracks: DataFrame) -> DataFrame:
    """The gaps between a parent's last frame and its first daughters' as repaired() wants them; they end in the mean of
    the positions of the daughters that begin first."""
    found = c.division_gaps(tracks)
    last = tracks.groupBy(SEQ, "label_track").agg(F.max(F.struct("t", "index", "center_0", "center_1")).alias("p"))
    born = tracks.select(SEQ, F.col("parent_track").alias("parent"), F.col("t").alias("first"), "center_0", "center_1").join(found.select(SEQ, "parent", "first"), [SEQ, "parent", "first"], "left_semi")
    to = born.groupBy(SEQ, "parent").agg(*(F.avg(f"center_{i}").alias(f"next_center_{i}") for i in (0, 1)))
    given = found.join(last.withColumnRenamed("label_track", "parent"), [SEQ, "parent"]).join(to, [SEQ, "parent"])
    return given.select(SEQ, F.col("parent").alias("label"), F.col("parent_last").alias("t"), F.col("first").alias("next_t"), F.lit(None).cast("long").alias("next_index"), *(F.col(f"p.center_{i}").alias(f"center_{i}") for i in (0, 1)), "next_center_0", "next_center_1")


#: Pixels around a footprint whose free part is its background; side of the tiles by which they are found.
MARGIN, TILE = 15, 32


def supported(images: DataFrame, pixels: DataFrame, found: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Those of the gaps ``found`` whose copy looks like a detection in one of their frames.

    Of images (sequence_id, t, y, x, intensity) the spread under the copy, less that of the free pixels in the box
    around it, is at least ``threshold`` times what the cell itself has at the gap's ends, less the same. A cell that
    is no more textured than that tells nothing: the gap stays. Without a mask before the gap it goes, without any
    intensity at its ends it stays."""
    masks, light, std = pixels.where("label != 0").select(SEQ, "t", "y", "x", "label"), images.select(SEQ, "t", "y", "x", "intensity"), F.stddev_pop("intensity")
    gaps = found.select(SEQ, "label", F.col("t").alias("_t"), "next_t")
    foot = masks.withColumnRenamed("t", "_t").join(gaps, [SEQ, "label", "_t"])
    ends = gaps.select(SEQ, "label", "_t", F.explode(F.array("_t", "next_t")).alias("t"))
    own = ends.join(masks, [SEQ, "label", "t"]).join(light, [SEQ, "t", "y", "x"]).groupBy(SEQ, "label", "_t", "t").agg(std.alias("_s")).groupBy(SEQ, "label", "_t").agg(F.avg("_s").alias("_ref"))
    at = foot.withColumn("t", F.explode(F.sequence(F.col("_t") + 1, F.col("next_t") - 1)))
    under = at.join(light, [SEQ, "t", "y", "x"]).groupBy(SEQ, "label", "_t", "t").agg(std.alias("_gap"))
    box = at.groupBy(SEQ, "label", "_t", "t").agg((F.min("y") - MARGIN).alias("_y0"), (F.max("y") + MARGIN).alias("_y1"), (F.min("x") - MARGIN).alias("_x0"), (F.max("x") + MARGIN).alias("_x1"))
    tile = lambda v: F.floor(v / TILE)
    box = box.withColumn("_ty", F.explode(F.sequence(tile(F.col("_y0")), tile(F.col("_y1"))))).withColumn("_tx", F.explode(F.sequence(tile(F.col("_x0")), tile(F.col("_x1")))))
    free = light.join(masks, [SEQ, "t", "y", "x"], "left_anti").withColumns({"_ty": tile(F.col("y")), "_tx": tile(F.col("x"))})
    ground = box.join(free, [SEQ, "t", "_ty", "_tx"]).where("y between _y0 and _y1 and x between _x0 and _x1").groupBy(SEQ, "label", "_t", "t").agg(std.alias("_bg"))
    given = under.join(ground, [SEQ, "label", "_t", "t"], "left").join(own, [SEQ, "label", "_t"], "left").withColumn("_bg", F.coalesce("_bg", F.lit(0.0)))
    score = F.when(F.col("_ref") - F.col("_bg") <= 1e-6, 1.0).otherwise((F.col("_gap") - F.col("_bg")) / (F.col("_ref") - F.col("_bg")))
    good = given.where(F.col("_ref").isNull() | (score >= threshold)).select(SEQ, "label", "_t")
    blind = foot.join(own, [SEQ, "label", "_t"], "left_anti").select(SEQ, "label", "_t")
    return found.join(good.union(blind).distinct().withColumnRenamed("_t", "t"), [SEQ, "label", "t"], "left_semi").select(*found.columns)
