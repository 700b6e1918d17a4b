"""The chain of repairs and its parts on small hand-made sequences; crops, shapes, registries and draws by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import chain, correction, crops, edges, numbering, registries, vectors, windows
from trackweave.sources import layout
from trackweave.sources.edge_store import EdgeStore, StoreMeta

TRACKS = "sequence_id string, index long, t int, label_track long, parent_track long, center_0 double, center_1 double, cell_source string"


def tracks_of(spark, spans, missing=()):
    """spans: label -> (parent, first, last, (y, x)); missing: (label, t) without a row."""
    rows, index = [], 0
    for label, (parent, first, last, (y, x)) in spans.items():
        for t in range(first, last + 1):
            if (label, t) not in missing:
                rows.append(("s", index, t, label, parent, float(y), float(x), "original"))
                index += 1
    return spark.createDataFrame(rows, TRACKS)


def masks_of(tracks, side=2):
    """Squares of pixels at the centres."""
    grid = tracks.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    return grid.select("sequence_id", "t", (F.col("center_0") + F.col("dy")).cast("int").alias("y"), (F.col("center_1") + F.col("dx")).cast("int").alias("x"), F.col("label_track").alias("label"))


def preds_of(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "sequence_id string, src long, dst long, p1 double, p2 double")


def test_short_tracks(spark):
    t = tracks_of(spark, {1: (0, 0, 20, (0, 0)), 2: (0, 5, 6, (9, 9)), 3: (1, 5, 6, (20, 9)), 4: (1, 19, 20, (30, 9))})
    assert {r.label_track for r in correction.short_tracks(t, 3).collect()} == {2, 3}
    assert {r.label_track for r in correction.short_tracks(t, 3, division_only=True).collect()} == {3}
    lone = tracks_of(spark, {1: (0, 0, 20, (0, 0)), 2: (0, 5, 6, (9, 9))})
    assert {r.label_track for r in correction.short_tracks(lone, 3).collect()} == {2}  # the end is that of all trajectories


EARLY = {1: (0, 0, 2, (10, 10)), 2: (1, 3, 4, (10, 10)), 3: (1, 3, 5, (10, 12)), 4: (0, 6, 8, (10, 11)), 10: (0, 0, 5, (40, 40)), 11: (10, 6, 20, (40, 40)), 12: (10, 6, 20, (40, 50))}


def test_early_divisions_are_merged(spark):
    t = tracks_of(spark, EARLY)
    px, none = masks_of(t), preds_of(spark, [(0, 1, 0.9, 0.0)])
    found = correction.early_divisions(t, px, none).collect()
    assert [(r.parent, r.label, r.sibling, r.successor) for r in found] == [(1, 2, 3, 4)]
    index = {(r.label_track, r.t): r["index"] for r in t.collect()}
    weak = preds_of(spark, [(index[3, 5], index[4, 6], 0.4, 0.0)])
    assert correction.early_divisions(t, px, weak).count() == 0
    strong = preds_of(spark, [(index[3, 5], index[4, 6], 0.4, 0.0), (index[1, 2], index[4, 6], 0.8, 0.0)])
    assert correction.early_divisions(t, px, strong).count() == 1
    apart = tracks_of(spark, EARLY | {3: (1, 3, 5, (10, 14))})
    assert correction.early_divisions(apart, masks_of(apart), none).count() == 0  # daughters that don't touch
    away = tracks_of(spark, EARLY | {4: (0, 6, 8, (30, 11))})
    assert correction.early_divisions(away, masks_of(away), none).count() == 0  # nothing covers the cell that appears
    merged = chain.merge_early_divisions()(chain.State(tracks_of(spark, EARLY | {6: (4, 9, 10, (10, 11)), 7: (4, 9, 10, (10, 14))}), px, none))
    rows = {(r.label_track, r.t): r for r in merged.tracks.collect()}
    assert all((1, k) in rows and rows[1, k].parent_track == 0 for k in (0, 3, 5, 6, 8)) and rows[1, 6].cell_source == "merged" and rows[6, 9].parent_track == 1
    assert {r.label for r in merged.pixels.where("t between 3 and 8 and y < 20").collect()} == {1}


def test_repairs_of_divisions_send_no_table_through_the_driver(spark):
    """rows and masks that an explode has made look small enough for a broadcast."""
    base = spark.range(200).select((F.col("id") * 10).alias("l"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("t"))
    t = base.select(F.concat(F.lit("s"), F.col("l") % 2).alias("sequence_id"), (F.col("l") * 100 + F.col("t")).alias("index"), "t", F.col("l").alias("label_track"), F.expr("l div 20").alias("parent_track"), F.lit(1.0).alias("center_0"), F.lit(1.0).alias("center_1"), F.lit("original").alias("cell_source"))
    px = base.select(F.concat(F.lit("s"), F.col("l") % 2).alias("sequence_id"), "t", F.col("l").cast("int").alias("y"), F.lit(1).alias("x"), F.col("l").alias("label"))
    preds = base.select(F.concat(F.lit("s"), F.col("l") % 2).alias("sequence_id"), F.col("l").alias("src"), (F.col("l") + 1).alias("dst"), F.lit(0.5).alias("p1"), F.lit(0.1).alias("p2"))
    for made in (correction.early_divisions, correction.merged_daughters):
        plan = made(t, px, preds)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") < 20, made.__name__  # 63 and 120 before; what is left joins results of joins, whose estimates are products


def test_merges_inside_gaps_go(spark):
    spans = {1: (0, 0, 9, (10, 10)), 2: (0, 0, 9, (10, 14)), 3: (0, 4, 5, (10, 12)), 4: (0, 0, 9, (40, 40))}
    t = tracks_of(spark, spans, {(1, 4), (1, 5), (2, 4), (2, 5)})
    index = {(r.label_track, r.t): r["index"] for r in t.collect()}
    across = [(index[1, 3], index[1, 6], 0.9, 0.0), (index[2, 3], index[2, 6], 0.9, 0.0)]
    gone = lambda preds, px=None: [r.label_track for r in correction.removable_merges(t, preds_of(spark, preds), 0.5, px).collect()]
    assert gone(across) == [3]
    assert gone(across[:1]) == []  # one of the cells doesn't link across
    assert gone([*across, (index[3, 5], index[4, 6], 0.9, 0.0)]) == []  # it is followed onwards
    wide = masks_of(t, 4)
    assert gone(across[:1], wide) == [3]  # the cells' masks cover it
    assert gone(across[:1], masks_of(t, 2)) == []
    done = chain.remove_merges()(chain.State(t, wide, preds_of(spark, across)))
    assert done.tracks.where("label_track = 3").isEmpty() and done.pixels.where("label = 3").isEmpty()


def test_merges_of_the_same_frames_are_asked_for_once(spark, monkeypatch):
    """what is around a merge follows from its frames; pairs were made for each merge, and joined with all rows of the others."""
    spans = {1: (0, 0, 9, (10, 10)), 2: (0, 0, 9, (10, 14)), **{k: (0, 4, 5, (10, 12)) for k in range(3, 9)}, 9: (0, 3, 6, (10, 12)), 10: (0, 4, 6, (10, 12)), 11: (0, 4, 7, (60, 12))}
    t = tracks_of(spark, spans, {(1, 4), (1, 5), (2, 4), (2, 5), (11, 5), (11, 6)})
    index = {(r.label_track, r.t): r["index"] for r in t.collect()}
    across = [(index[1, 3], index[1, 6], 0.9, 0.0), (index[2, 3], index[1, 6], 0.9, 0.0)]
    asked, around = [], correction.around
    monkeypatch.setattr(correction, "around", lambda tracks, inner: asked.append(inner.count()) or around(tracks, inner))
    gone = lambda preds, px=None: sorted(r.label_track for r in correction.removable_merges(t, preds_of(spark, preds), 0.5, px).collect())
    assert gone([*across, (index[4, 5], index[5, 4], 0.9, 0.0)]) == [3, 5, 6, 7, 8] and asked == [1]
    assert gone(across[:1], masks_of(t.where("label_track < 4"), 4)) == [3]


MERGED = {1: (0, 0, 2, (10, 10)), 2: (1, 3, 5, (10, 10)), 3: (1, 3, 5, (10, 12)), 4: (0, 6, 7, (10, 11)), 5: (4, 8, 12, (10, 10)), 6: (4, 8, 12, (10, 12)), 9: (0, 0, 12, (50, 50))}


def test_merged_daughters_are_split(spark):
    t = tracks_of(spark, MERGED)
    index = {(r.label_track, r.t): r["index"] for r in t.collect()}
    out = [(index[4, 6], index[5, 8], 0.1, 0.9), (index[4, 6], index[6, 8], 0.1, 0.8), (index[4, 6], index[9, 7], 0.1, 0.3)]
    px, preds = masks_of(t), preds_of(spark, out)
    found = correction.merged_daughters(t, px, preds).collect()
    assert [(r.parent, r.a, r.b, r.merged, r.t, r.after_a, r.after_b) for r in found] == [(1, 2, 3, 4, 6, index[5, 8], index[6, 8])]
    assert correction.merged_daughters(t, px, preds_of(spark, out[:1])).count() == 0  # nothing reappears as two
    little = [(*x[:3], 0.2) for x in out]
    assert correction.merged_daughters(t, px, preds_of(spark, little), least_coverage=1.1).count() == 0  # neither coverage nor a link
    assert correction.merged_daughters(t, px, preds_of(spark, [*little, (index[1, 2], index[4, 6], 0.9, 0.0)]), least_coverage=1.1).count() == 1
    done = chain.split_merged_daughters()(chain.State(t, px, preds))
    rows = {(r.label_track, r.t): r for r in done.tracks.collect()}
    assert {label for label, _ in rows} == {1, 2, 3, 9} and {k for label, k in rows if label == 2} == {*range(3, 7), *range(8, 13)}
    assert rows[2, 6].cell_source == "split" and all(r.parent_track == 1 for (label, _), r in rows.items() if label in (2, 3))
    assert {(r.t, r.label) for r in done.pixels.where("y < 20 and label > 0 and t >= 6").select("t", "label").distinct().collect()} == {(k, label) for k in (6, *range(8, 13)) for label in (2, 3)}


def test_merges_in_a_row(spark):
    """What follows the first merge carries its daughters on; the second merge of the same cells then has no masks of
    theirs and stays; a third, after it, is split again."""
    spans = MERGED | {5: (4, 8, 10, (10, 10)), 6: (4, 8, 10, (10, 12)), 14: (0, 11, 12, (10, 11)), 15: (14, 13, 15, (10, 10)), 16: (14, 13, 15, (10, 12)), 24: (0, 16, 17, (10, 11)), 25: (24, 18, 20, (10, 10)), 26: (24, 18, 20, (10, 12))}
    t = tracks_of(spark, spans | {9: (0, 0, 20, (50, 50))})
    index = {(r.label_track, r.t): r["index"] for r in t.collect()}
    out = [(index[m, at], index[x, at + 2], 0.1, p) for m, at, pair in ((4, 6, (5, 6)), (14, 11, (15, 16)), (24, 16, (25, 26))) for x, p in zip(pair, (0.9, 0.8), strict=True)]
    px, preds = masks_of(t), preds_of(spark, out)
    splits = correction.merged_daughters(t, px, preds)
    assert sorted((r.merged, r.a, r.b) for r in splits.collect()) == [(4, 2, 3), (14, 5, 6), (24, 15, 16)]
    made = correction.split_order(splits, correction.split_names(t, splits)).collect()
    assert sorted((r.merged, r.draws_a, r.draws_b) for r in made) == [(4, True, True), (24, True, True)]
    done = chain.split_merged_daughters()(chain.State(t, px, preds))
    have = {label: sorted(r.t for r in done.tracks.where(f"label_track = {label}").collect()) for label in (2, 3, 5, 6, 14, 15, 16, 24, 25)}
    assert have[2] == have[3] == [3, 4, 5, 6, 8, 9, 10] and have[14] == [11, 12] and have[15] == have[16] == [13, 14, 15, 16, 18, 19, 20]
    assert not any(have[x] for x in (5, 6, 24, 25))


def test_gaps_before_divisions_are_closed(spark):
    t = tracks_of(spark, {1: (0, 0, 2, (10, 10)), 2: (1, 5, 8, (10, 20)), 3: (1, 5, 8, (20, 20))})
    done = chain.close_division_gaps()(chain.State(t, masks_of(t), preds_of(spark, [(0, 1, 0.5, 0.0)])))
    assert {(r.t, r.parent_track) for r in done.tracks.where("label_track = 1").collect()} == {(k, 0) for k in range(5)}
    assert done.pixels.where("label = 1 and t in (3, 4)").count() == 8 and correction.violations(done.tracks, done.pixels).count() == 0


def test_chain_of_repairs(spark):
    spans = {1: (0, 0, 9, (10, 10)), 2: (0, 0, 9, (10, 14)), 3: (0, 4, 5, (10, 12)), 5: (0, 0, 9, (60, 60)), 20: (0, 0, 2, (80, 10)), 21: (20, 3, 20, (80, 10)), 22: (20, 3, 20, (80, 14))}
    t = tracks_of(spark, spans, {(1, 4), (1, 5), (2, 4), (2, 5), (5, 7)})
    index = {(r.label_track, r.t): r["index"] for r in t.collect()}
    preds = preds_of(spark, [(index[1, 3], index[1, 6], 0.9, 0.0), (index[2, 3], index[2, 6], 0.9, 0.0)])
    done = chain.validated(chain.correct(chain.State(t, masks_of(t, 4).groupBy("sequence_id", "t", "y", "x").agg(F.max("label").alias("label")), preds)))
    have = {(r.label_track, r.t) for r in done.tracks.collect()}
    assert (5, 7) in have and not any(label == 3 for label, _ in have) and {(1, 4), (1, 5), (2, 4), (2, 5)} <= have
    with pytest.raises(chain.InvalidLineage, match="gap"):
        chain.validated(chain.State(t, masks_of(t), preds))


def test_a_failing_repair_restores_what_was_before_all(spark):
    t = tracks_of(spark, {1: (0, 0, 3, (0, 0))})
    state, ran = chain.State(t, masks_of(t), preds_of(spark, [(0, 1, 0.5, 0.0)])), []

    def fails(s):
        raise RuntimeError("no")

    def drops(s):
        ran.append("drops")
        return chain.replace(s, tracks=s.tracks.where("t < 2"))

    assert chain.correct(state, [drops, fails, drops]).tracks.count() == 4 and ran == ["drops"]
    assert chain.correct(state, [drops]).tracks.count() == 2


def test_a_failure_of_the_chain_is_no_result(spark, monkeypatch):
    """A stage that failed, a session without a shared folder and a rule that is broken all gave the given tracks, with nothing to tell."""
    from trackweave import storage
    from trackweave.plans import chain_plans

    t = tracks_of(spark, {1: (0, 0, 3, (0, 0)), 2: (0, 0, 3, (0, 9))}).withColumn("sequence_id", F.concat(F.lit("s"), F.col("label_track").cast("string")))
    state = chain.State(t, masks_of(t), preds_of(spark, [(0, 1, 0.5, 0.0)]))

    def fails(s):
        raise RuntimeError("no")

    assert chain.correct(state, [fails]).failed.endswith(": no")
    with pytest.raises(RuntimeError, match="no"):
        chain.correct(state, [fails], strict=True)

    def unset(s):
        raise storage.NoSharedFolder("unset")

    with pytest.raises(storage.NoSharedFolder):
        chain.correct(state, [unset])
    done = chain.correct(state, [lambda s: chain.replace(s, tracks=s.tracks.where("label_track = 1 or t != 1"))])
    assert done.failed is None and {(r.sequence_id, r.rule) for r in done.uncorrected.collect()} == {("s2", "gap")}
    monkeypatch.setattr(chain, "default_stages", lambda: [fails])
    monkeypatch.setattr(chain_plans, "_state", lambda *a: state)
    monkeypatch.setattr(chain_plans, "_sequences", lambda *a: state)
    for query in (chain_plans._c1, chain_plans._c1_sequences, chain_plans._left):
        with pytest.raises(RuntimeError, match="no"):
            query(spark, "")
    monkeypatch.setattr(chain, "default_stages", lambda: [lambda s: chain.replace(s, tracks=s.tracks.where("label_track = 1 or t != 1"))])
    assert {(r.label_track, r.corrected) for r in chain_plans._c1(spark, "").collect()} == {(1, True), (2, False)}
    assert {(r.sequence_id, r.valid) for r in chain_plans._c1_sequences(spark, "").collect()} == {("s1", True), ("s2", False)}


def test_lineage_files_and_names():
    names = ["d/states.txt", "d/01_GT/TRA/man_track.txt", "d/res_track.txt"]
    assert layout.find_lineage(names, "d/01_GT/TRA") == "d/states.txt"
    assert layout.find_lineage(names[1:], "d/01_GT/TRA") == "d/01_GT/TRA/man_track.txt"
    assert layout.find_lineage(names[2:], "d/01_GT/TRA/") == "d/res_track.txt" and layout.find_lineage([], "d") is None
    assert layout.shared_id("a/x1_img.tif", "a/x1_seg.tif") == "x1" and layout.shared_id("img.tif", "seg.tif") is None


def test_edge_store_made_anew_keeps_nothing(spark, tmp_path):
    def links(strides, radius):
        return spark.createDataFrame([("s", k, k + 1, 0, k, float(r)) for k in strides for r in (1, 5, 9) if r <= radius], "sequence_id string, src long, dst long, t int, dist_temp int, dist_spat double")

    store = EdgeStore(spark, str(tmp_path / "store"))
    assert store.get(StoreMeta(5.0, False, [], "a", [1, 2]), links).count() == 4 and store.strides() == [1, 2]
    assert store.get(StoreMeta(5.0, False, [], "a", [3]), links).count() == 2 and store.strides() == [1, 2, 3]
    assert store.get(StoreMeta(9.0, False, [], "a", [2]), links).count() == 3 and store.strides() == [2]


def test_draws_and_dropout_repeat(spark):
    weights = spark.createDataFrame([("a", 0.7), ("b", 0.0), ("c", 0.25), ("d", 0.05)], "sequence_id string, mass double")
    draws = [sorted((r.draw, r.sequence_id) for r in windows.weighted_draws(weights.repartition(n), 4000, 3).collect()) for n in (1, 5)]
    assert draws[0] == draws[1] and [d for d, _ in draws[0]] == list(range(4000))
    share = {s: sum(x == s for _, x in draws[0]) / 4000 for s in "abcd"}
    assert share["b"] == 0 and abs(share["a"] - 0.7) < 0.03 and abs(share["c"] - 0.25) < 0.03 and share["d"] > 0.02
    df = spark.range(10_000).withColumn("sequence_id", F.lit("s"))
    kept = [sorted(r.id for r in windows.hash_sample(df.repartition(n), 0.3, 1, "id").collect()) for n in (1, 6)]
    assert kept[0] == kept[1] and abs(len(kept[0]) - 3000) < 200
    most = [sorted(r.id for r in windows.capped(df.repartition(n), 50, 2, "id").collect()) for n in (1, 6)]
    assert most[0] == most[1] and len(most[0]) == 50


def test_numbers_by_range_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if rng.random() < 0.7 else f"s{rng.integers(3)}", int(v), k) for k, v in enumerate(rng.integers(0, 50, 600))]
    got = numbering.numbered(spark.createDataFrame(rows, "sequence_id string, v int, k int").repartition(7), "n", "v", "k").collect()
    want = {}
    for s in {r[0] for r in rows}:
        want |= {(s, k): n for n, (v, k) in enumerate(sorted((v, k) for q, v, k in rows if q == s), 1)}
    assert {(r.sequence_id, r.k): r.n for r in got} == want


def test_crops_and_weights(spark):
    rng = np.random.default_rng(5)
    image, label = rng.random((12, 14)), rng.integers(0, 3, (12, 14))
    px = spark.createDataFrame([("s", 0, y, x, int(label[y, x]), float(image[y, x])) for y in range(12) for x in range(14)], "sequence_id string, t int, y int, x int, label long, intensity double")
    boxes = [("s", 0, 1, 1, 2, 3, 6), ("s", 0, 2, 2, -3, 9, 8), ("s", 0, 3, 1, 0, 0, 0)]
    df = spark.createDataFrame(boxes, "sequence_id string, t int, index long, label long, crop_0 int, crop_1 int, side int")
    for pad in ("constant", "edge"):
        got = {r["index"]: r for r in crops.crops(px, df, 4, pad).collect()}
        assert set(got) == {1, 2}
        for _, _, index, own, y0, x0, side in boxes[:2]:
            ys, xs = np.arange(y0, y0 + side), np.arange(x0, x0 + side)
            inside = ((ys >= 0) & (ys < 12))[:, None] & ((xs >= 0) & (xs < 14))
            near = image[np.ix_(np.clip(ys, 0, 11), np.clip(xs, 0, 13))]
            whole = near if pad == "edge" else np.where(inside, near, 0)
            assert np.allclose(got[index].patch, crops.resized(whole, 4).ravel())
            mask = np.where(inside, label[np.ix_(np.clip(ys, 0, 11), np.clip(xs, 0, 13))] == own, False)
            assert got[index].mask == crops.nearest(mask, 4).ravel().astype(float).tolist()
    mask = np.zeros((6, 6), bool)
    mask[1, 2] = mask[4, 4] = True
    ys, xs = np.nonzero(mask)
    brute = np.sqrt(((np.arange(6)[:, None, None] - ys) ** 2 + (np.arange(6)[None, :, None] - xs) ** 2).min(-1))
    assert np.allclose(crops.distance_to(mask), brute)
    assert np.allclose(crops.patch_weights(mask, 2.0, 3), ((1 - brute / brute.max()) ** 2).reshape(2, 3, 2, 3).mean((1, 3)).ravel())
    assert crops.patch_weights(mask, None, 3).tolist() == [1 / 9, 0, 0, 1 / 9] and crops.patch_weights(~np.zeros((6, 6), bool), 1.0, 3).tolist() == [1.0] * 4


def test_boxes_meet_pixels_by_squares(spark):
    """a box is copied for the squares it touches, not for each of its pixels; sides differ, some begin before 0."""
    px = [("s", 0, y, x, (y + x) % 3, float(y * 20 + x)) for y in range(20) for x in range(0, 20, 1 + y % 2)]
    boxes = [("s", 0, k, k % 3, -3 + 5 * k, 11 - 4 * k, 1 + 6 * (k % 3)) for k in range(5)]
    pixels = spark.createDataFrame(px, "sequence_id string, t int, y int, x int, label long, intensity double")
    given = crops.crop_pixels(pixels, spark.createDataFrame(boxes, "sequence_id string, t int, index long, label long, crop_0 int, crop_1 int, side int"))
    want = sorted((k, y - low, x - left, light, mine == label) for _, _, k, label, low, left, side in boxes for _, _, y, x, mine, light in px if low <= y < low + side and left <= x < left + side)
    assert want and sorted(tuple(r) for r in given.select("index", "dy", "dx", "intensity", "own").collect()) == want
    assert "_sy" in given._jdf.queryExecution().executedPlan().toString()


def test_shapes(spark):
    bar = [("s", 0, y, x, 7) for y in range(5, 10) for x in range(20)] + [("s", 0, 30, 30, 8)]
    ell = [("s", 1, y, x, 9) for y in range(20) for x in range(20) if y >= 17 or x < 3]
    got = {r.label: r for r in crops.shapes(spark.createDataFrame(bar + ell, "sequence_id string, t int, y int, x int, label long")).collect()}
    assert (got[7].center_local_0, got[7].solidity, got[7].thickness) == (2.0, 1.0, 6.0) and 8 <= got[7].center_local_1 <= 11 and got[7].septum_width == 6.0
    assert (got[8].center_local_0, got[8].center_local_1, got[8].thickness, got[8].solidity) == (0.0, 0.0, 2.0, 1.0)
    assert got[9].solidity < 0.6 and (got[9].center_local_0 >= 17 or got[9].center_local_1 < 3)  # the middle lies on the object


def test_shapes_of_scattered_pixels(spark):
    """An object's work is its pixels': a box of 10**10 pixels, a square that thinning eats, parts against whole masks."""
    rng = np.random.default_rng(12)
    px = [("s", 0, 0, 0, 1), ("s", 0, 100_000, 100_000, 1)] + [("s", 0, y, x, 2) for y in (4, 5) for x in (7, 8)]
    masks = {label: rng.random((14, 17)) < share for label, share in zip(range(10, 22), [0.05, 0.2, 0.5, 0.8] * 3, strict=True)}
    px += [("s", 0, y, x, label) for label, m in masks.items() for y, x in np.argwhere(m).tolist()] * 2
    got = {r.label: r for r in crops.shapes(spark.createDataFrame(px, "sequence_id string, t int, y int, x int, label long")).collect()}
    assert len(got) == 14 and (got[1].thickness, got[1].septum_width) == (2.0, 2.0) and got[1].solidity < 1e-4
    assert (got[2].thickness, got[2].solidity) == (2.0, 1.0)
    for label, m in masks.items():
        m = m[np.ix_(m.any(1).nonzero()[0].min() + np.arange(np.ptp(m.any(1).nonzero()[0]) + 1), m.any(0).nonzero()[0].min() + np.arange(np.ptp(m.any(0).nonzero()[0]) + 1))]
        inner = crops.distance_to(np.pad(~m, 1, constant_values=True))[1:-1, 1:-1]
        cy, cx = crops.axis_midpoint(np.argwhere(crops.thinned(m)))
        assert (got[label].center_local_0, got[label].center_local_1) == (cy, cx)
        assert (got[label].thickness, got[label].septum_width) == (2 * inner.max(), 2 * inner[int(cy), int(cx)])


def test_registries(spark):
    own = registries.Registry("node property")

    @own.add("twice")
    def twice(df, column="a"):
        return df.withColumn("twice", F.col(column) * 2)

    own.add("more")(lambda df, column="a": df.withColumn("more", F.col("twice") + 1))
    assert list(own) == ["twice", "more"] and "twice" in own
    assert own.apply(spark.createDataFrame([(3,)], "a int"), ["twice", "more"]).first().more == 7
    with pytest.raises(KeyError, match="no node property 'none'.*more.*twice"):
        own["none"]
    with pytest.raises(ValueError, match="already"):
        own.add("twice")(twice)
    assert "aspect_ratio" in registries.NODE_TRANSFORMS and "softmax" in registries.NORMALISERS


def test_dilated_overlap(spark):
    rng = np.random.default_rng(6)
    squares = [("s", t, label, int(rng.integers(0, 60)), int(rng.integers(0, 60)), int(rng.integers(2, 7))) for t in (0, 1) for label in range(12)]
    px, at = [], {}
    for s, t, label, y0, x0, side in squares:
        for y in range(y0, y0 + side):
            for x in range(x0, x0 + side):
                at[s, t, y, x] = label + 1
    px = [(s, t, y, x, label) for (s, t, y, x), label in at.items()]
    nodes = [("s", t, label + 1, 100 * t + label, 1.0 + label % 3) for _, t, label, *_ in squares]
    links = [("s", a, 100 + b, 0) for a in range(12) for b in range(12)]
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = {(r.src, r.dst) for r in edges.dilated_overlap(df(links, "sequence_id string, src long, dst long, t int"), df(px, "sequence_id string, t int, y int, x int, label long"), df(nodes, "sequence_id string, t int, label long, index long, thickness double")).collect()}

    def rim(t, label):
        own = sorted((y, x) for (_, u, y, x), v in at.items() if (u, v) == (t, label))
        return [(y, x) for y, x in own if any((y + dy, x + dx) not in set(own) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))][::3]

    want = set()
    for a in range(12):
        for b in range(12):
            p, q = rim(0, a + 1), rim(1, b + 1)
            if p and q and min(np.hypot(y - v, x - u) for y, x in p for v, u in q) <= 2.5 * (2 + a % 3 + b % 3):
                want.add((a, 100 + b))
    assert got == want and 10 < len(got) < 140


def test_message_network(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6, 2))
    links = [(0, 1), (1, 2), (2, 1), (0, 3), (4, 3), (5, 0)]
    layers = [(rng.normal(size=(3, 6)).tolist(), rng.normal(size=3).tolist()), (rng.normal(size=(2, 9)).tolist(), rng.normal(size=2).tolist())]
    want = x
    for w, b in layers:
        rows = []
        for k in range(6):
            sides = [[want[s] for s, d in links if d == k and (s < d) == past] for past in (True, False)]
            parts = [np.mean(m, 0) if m else np.zeros(want.shape[1]) for m in sides]
            rows.append(np.maximum(np.array(w) @ np.concatenate([*parts, want[k]]) + np.array(b), 0))
        want = np.array(rows)
    nodes = spark.createDataFrame([("s", k, v.tolist()) for k, v in enumerate(x)], "sequence_id string, index long, embedding array<double>")
    got = vectors.network(nodes, spark.createDataFrame([("s", a, b) for a, b in links], "sequence_id string, src long, dst long"), layers)
    assert np.allclose([r.embedding for r in got.orderBy("index").collect()], want)


@pytest.mark.parametrize("rescue", [False, True])
def test_matching_by_component_is_matching_of_the_whole_sequence(spark, rescue):
    from trackweave.operators import matching

    rng = np.random.default_rng(11)
    rows = []
    for s in ("a", "b"):
        for t in range(9):
            for _ in range(14):
                src = 100 * t + int(rng.integers(0, 12))
                rows.append((s, t, src, 100 * (t + int(rng.integers(1, 3))) + int(rng.integers(0, 12)), float(rng.integers(1, 99)) / 100, float(rng.integers(1, 99)) / 100, "division" if rng.random() < 0.3 else "correspondence"))
    rows += [("a", 0, 5000, 5001, 0.9, 0.1, "correspondence"), ("a", 0, 5001, 5002, 0.8, 0.1, "correspondence"), ("a", 0, 5002, 5003, 0.8, 0.1, "correspondence")]  # tried again in later frames
    rows = list({(r[0], r[2], r[3]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "sequence_id string, t int, src long, dst long, p1 double, p2 double, kind string")
    whole = df.toPandas()
    want = set()
    for s, pdf in whole.groupby("sequence_id"):
        place = {t: k for k, t in enumerate(sorted(set(pdf["t"])), 1)}
        out = matching._fold(2, rescue)(pdf.assign(rank=pdf["t"].map(place), ranks=len(place)))
        want |= {(s, *r) for r in out[["src", "dst", "type"]].itertuples(index=False, name=None)}
    got = {(r.sequence_id, r.src, r.dst, r.type) for r in matching.link(df, rescue=rescue).collect()}
    assert got == want and {("a", 5000, 5001, "correspondence"), ("a", 5002, 5003, "correspondence")} <= got


def test_covered_trajectories_come_without_all_pairs(spark):
    """What lies in a gap is told by the furthest gap, the pairs are dealt over salts and come once."""
    rows = [(0, 1), (9, 1), (0, 2), (5, 2), (8, 2), (2, 3), (3, 3), (6, 4), (4, 5), (7, 5)]
    t = spark.createDataFrame([("s", i, *r, 0, 0.0, 0.0, "original") for i, r in enumerate(rows)], TRACKS)
    pairs = sorted((r.inner, r.outer) for r in correction.covering(t).collect())
    assert pairs == [(3, 1), (3, 2), (4, 1), (4, 2), (4, 5), (5, 1)]
    assert sorted(r.label_track for r in correction.gap_only(t).collect()) == [3, 4, 5]
    plan = correction.covering(t)._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith("Aggregate") and "_salt" in plan
    every = sorted((r.inner, r.outer) for r in correction.around(t).collect())
    some = sorted((r.inner, r.outer) for r in correction.around(t, t.where("label_track = 3").select("sequence_id", "label_track").distinct()).collect())
    assert some == [p for p in every if p[0] == 3] == [(3, 1), (3, 2)]
