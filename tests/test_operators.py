"""Golden inputs of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from trackweave.operators import correction, edges, lineage, matching, metrics, nodes, pixels, predictions, vectors, windows
from trackweave.operators.lineage import lbep


def nodes_table(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "sequence_id string, index long, t int, label long, center_0 double, center_1 double")


def test_radius_join(spark):
    n = nodes_table(spark, [(0, 0, 10, 10.0, 10.0), (1, 0, 20, 50.0, 50.0), (2, 1, 10, 51.0, 51.0)])
    got = edges.radius_join(n, [1], 5.0, ["center_0", "center_1"]).collect()
    assert [(r.src, r.dst, round(r.dist_spat, 6)) for r in got] == [(1, 2, round(math.sqrt(2), 6))]


def test_radius_join_sends_no_side_through_the_driver(spark):
    """the estimate of a side leaves out the copies that strides and cells make, so it looked fit for a broadcast."""
    n = nodes_table(spark, [(0, 0, 10, 10.0, 10.0), (1, 1, 10, 11.0, 11.0)])
    for columns in ([], ["label"]):
        plan = edges.radius_join(n, [1], 5.0, ["center_0", "center_1"], columns)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan


def test_columns_that_the_join_brings_along(spark):
    """what attach adds to the pairs, with null and repeated indices, but no join of pairs."""
    rows = [(i % 40, i % 3, i % 7, float(i * 7 % 30), float(i * 11 % 30)) for i in range(60)] + [(None, 1, 3, 5.0, 5.0)]
    n = nodes_table(spark, rows)
    names = ["label", "center_0"]
    key = lambda df: sorted(tuple(r) for r in df.select("sequence_id", "src", "dst", "t", "dist_temp", "dist_spat", "label_src", "label_dst", "center_0_src", "center_0_dst").collect())
    made = edges.radius_join(n, [1, 2], 8.0, ["center_0", "center_1"], names)
    want = key(edges.attach(edges.radius_join(n, [1, 2], 8.0, ["center_0", "center_1"]), n, names))
    assert len(want) > 20 and key(made) == want
    assert made._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 3  # one of nodes for each side, one of the sides
    both = edges.mirror(made.select("sequence_id", "src", "dst", "t", "dist_temp"))
    assert "Union" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 2 * len(want)


def test_radius_join_at_the_borders_of_cells(spark):
    """against all pairs, on multiples of the radius and far out; a node without a finite position is near none (it was an overflow)."""
    places = [(y, x) for y in (-40.0, -20.0, -1e-16, 0.0, 20.0, 20.1, 40.0, 1e12, 1e12 + 20) for x in (-20.0, 0.1, 20.1, 60.0)]
    places += [(float("inf"), 0.1), (-float("inf"), 0.1), (float("nan"), 0.1), (None, 0.1)]
    rows = [(2 * k + t, t, 1, y, x) for k, (y, x) in enumerate(places) for t in (0, 1)]
    want = sorted((a[0], b[0]) for a in rows for b in rows if b[1] - a[1] == 1 and None not in (a[3], b[3]) and math.sqrt((a[3] - b[3]) * (a[3] - b[3]) + (a[4] - b[4]) * (a[4] - b[4])) <= 20.0)
    got = edges.radius_join(nodes_table(spark, rows), [1], 20.0, ["center_0", "center_1"])
    assert len(want) > 100 and sorted((r.src, r.dst) for r in got.collect()) == want


def test_links_of_patches_by_their_nodes(spark):
    """what patch_edges gives for all links, without a join of links."""
    centre = ["center_0", "center_1"]
    n = nodes_table(spark, [(i, i % 4, i % 7, float(i * 7 % 41) - 10, float(i * 11 % 43) - 10) for i in range(80)])
    boxes = windows.patches(n, 12, 0.25, centre).where("low_0 > -5")
    key = lambda df: sorted(tuple(r) for r in df.select("sequence_id", "t", "dist_temp", "low_0", "high_0", "low_1", "high_1", "src", "dst").collect())
    want = key(windows.patch_edges(edges.radius_join(n, [1, 2], 9.0, centre, centre), boxes, centre, 12))
    made = edges.patch_links(n, [1, 2], 9.0, centre, boxes, 12)
    assert len(want) > 50 and key(made) == want


def test_links_that_are_near(spark):
    """truth is held against the radius rule itself, not against all links within it."""
    centre = ["center_0", "center_1"]
    n = nodes_table(spark, [(i % 50, i % 4, i % 7, float(i * 7 % 30), float(i * 11 % 30)) for i in range(60)])
    truth = n.select("sequence_id", F.col("index").alias("src"), F.explode(F.expr("sequence(0L, 49L, 3L)")).alias("dst"), F.lit(1).alias("y"))
    key = lambda kept: [(r.y, r.n, r.share) for r in edges.pruned_truth(truth, kept).collect()]
    near = edges.near_links(truth, n, [1, 2], 8.0, centre)
    assert 20 < near.distinct().count() < truth.distinct().count() and key(near) == key(edges.radius_join(n, [1, 2], 8.0, centre))


def test_window_links(spark):
    """what the joins of links with window pairs and local ids give, without a join of links."""
    centre = ["center_0", "center_1"]
    n = nodes_table(spark, [(i, i % 4, i % 7, float(i * 7 % 30), float(i * 11 % 30)) for i in range(60)])
    pairs = windows.window_pairs(n.select("sequence_id", "t").distinct(), [1, 2], 0.5, False)
    links = windows.edges_of_pairs(edges.radius_join(n, [1, 2], 8.0, centre), pairs)
    key = lambda df, *c: sorted(tuple(r) for r in df.select("sequence_id", "window_t", "src", "dst", *c).collect())
    assert key(edges.radius_join(n, pairs, 8.0, centre), "dist_temp", "dist_spat") == key(links, "dist_temp", "dist_spat")
    ids = windows.local_ids(links).where("index % 5 > 0")
    made = edges.window_links(n, pairs, 8.0, centre, ids)
    want = key(windows.remap(links, ids), "src_local", "dst_local")
    assert len(want) > 20 and key(made, "src_local", "dst_local") == want
    other = ids.withColumn("index", F.col("index") + 1000).where("local > 0")
    named = predictions.remap_to_nodes(windows.remap(links, ids).select("sequence_id", F.col("window_t").alias("window"), F.col("src_local").alias("src"), F.col("dst_local").alias("dst")), other.withColumnRenamed("window_t", "window"))
    assert key(edges.window_links(n, pairs, 8.0, centre, ids, other)) == key(named.withColumnRenamed("window", "window_t"))


def test_links_of_patches(spark):
    """a link in a box by both ends is given once, links that are there twice stay twice, and links are made once."""
    n = nodes_table(spark, [(0, 0, 10, 1.0, 1.0), (1, 1, 10, 3.0, 3.0), (2, 1, 11, 12.0, 12.0)])
    links = edges.radius_join(n, [1], 20.0, ["center_0", "center_1"], ["center_0", "center_1"])
    boxes = spark.createDataFrame([("s", 0, 0, 10, 0, 10), ("s", 0, 8, 18, 8, 18)], "sequence_id string, t int, low_0 int, high_0 int, low_1 int, high_1 int")
    got = windows.patch_edges(links.union(links.where("dst = 2")), boxes, ["center_0", "center_1"], 10)
    assert sorted((r.low_0, r.dst) for r in got.collect()) == [(0, 1), (0, 2), (0, 2), (8, 2), (8, 2)]
    assert "Union" not in windows.patch_edges(links, boxes, ["center_0", "center_1"], 10)._jdf.queryExecution().executedPlan().toString()


def test_labels_and_division_classes(spark):
    df = spark.createDataFrame([(10, 20, 0, 10), (10, 30, 0, 10), (5, 5, 0, 0), (5, 6, None, None)], "label_src int, label_dst int, parent_src int, parent_dst int")
    labelled = edges.label_edges(df)
    assert [r.y for r in labelled.collect()] == [2, 2, 1, 0]
    for name, value in (("division", 2), ("correspondence", 1), ("negative", 0)):
        assert [r.y for r in edges.relabel_divisions(labelled, name).collect()] == [value, value, 1, 0]


def test_an_ellipse_without_extent_keeps_nothing(spark):
    """an axis of 0 was a division by zero."""
    rows = [(0.0, 0.0, y, 0.0, major, minor, 0.0) for y in (0.0, 5.0) for major, minor in ((20.0, 10.0), (0.0, 10.0), (20.0, 0.0), (0.0, 0.0))]
    df = spark.createDataFrame(rows, "center_0_src double, center_1_src double, center_0_dst double, center_1_dst double, axis_major_length_src double, axis_minor_length_src double, orientation_src double")
    assert sorted((r.center_0_dst, r.axis_major_length_src, r.axis_minor_length_src) for r in edges.prune(df, "ellipse", 1.0).collect()) == [(0.0, 20.0, 10.0), (5.0, 20.0, 10.0)]


def test_pruning(spark):
    df = spark.createDataFrame([(2.82, 10.0), (20.0, 10.0)], "dist_spat double, axis_major_length_src double")
    assert edges.prune(df, "radius", 1.0).count() == 1 and edges.prune(df, "radius", 4.0).count() == 2
    ellipse = spark.createDataFrame([(0.0, 0.0, y, x, 20.0, 10.0, math.pi / 4) for y, x in ((5.0, 5.0), (15.0, 0.0))], "center_0_src double, center_1_src double, center_0_dst double, center_1_dst double, axis_major_length_src double, axis_minor_length_src double, orientation_src double")
    assert [r.center_0_dst for r in edges.prune(ellipse, "ellipse", 1.0).collect()] == [5.0]
    truth = spark.createDataFrame([(1, 1), (2, 1), (0, 1), (1, 1), (1, -1)], "y int, dist_temp int")
    assert edges.prune(truth, "gt").count() == 3
    with pytest.raises(ValueError):
        edges.prune(df, "nearest")


def test_size_normalisation(spark):
    df = spark.createDataFrame([("s", i, t, a, b) for i, (t, a, b) in enumerate([(0, 10.0, 50.0), (0, 20.0, 70.0), (1, 15.0, 60.0), (1, 25.0, 80.0)])], "sequence_id string, index long, t int, axis_major_length double, area double")
    got = nodes.size_normalisation(df, ["axis_major_length", "area"]).orderBy("index").collect()
    assert got[0].len_init == 15 and got[0].area_init == 60
    assert abs(got[0].axis_major_length_norm - math.log(10 / 15)) < 1e-5 and abs(got[0].area_norm - math.log(50 / 60)) < 1e-5
    assert nodes.search_radius(df, "2.5x").first().radius == 38
    with pytest.raises(ValueError):
        nodes.search_radius(df, "wide")


def test_edge_transform(spark):
    df = spark.createDataFrame([("s", 5.0, 1), ("s", 15.0, 2)], "sequence_id string, dist_spat double, dist_temp int")
    got = edges.transform_features(df, "cell_size", 10.0).orderBy("dist_spat").collect()
    assert [round(r.dist_spat, 4) for r in got] == [round(math.log(0.5), 4), round(math.log(1.5), 4)]
    assert [round(r.dist_temp, 6) for r in got] == [round(math.log(2), 6), round(math.log(3), 6)]
    assert [round(r.dist_temp, 6) for r in edges.transform_features(df, "cell_size", 5.0, 3.0).orderBy("dist_spat").collect()] == [round(math.log(4), 6), round(math.log(7), 6)]
    assert [r.dist_spat for r in edges.transform_features(df, "min_max").orderBy("dist_spat").collect()] == [0.0, 1.0]


def test_lineage_edges(spark):
    rows = [("s", i, t, label, parent) for i, (t, label, parent) in enumerate(zip([0, 1, 2, 2, 3, 2, 3], [1, 1, 1, 2, 2, 3, 3], [0, 0, 0, 1, 1, 1, 1], strict=True))]
    got = edges.lineage_edges(spark.createDataFrame(rows, "sequence_id string, index long, t int, label long, parent long")).collect()
    assert {(r.src, r.dst, r.y) for r in got} == {(0, 1, 1), (1, 2, 1), (3, 4, 1), (5, 6, 1), (2, 3, 2), (2, 5, 2)}


@pytest.mark.parametrize("pair,frames,both,want", [((10, 10), 40, True, [(10, 20)]), ((38, 10), 40, True, [(28, 38)]), ((-5, 10), 40, True, [(5, 15)]), ((5, 15), 8, True, []), ((38, 10), 40, False, [])])
def test_boundary_pairs(spark, pair, frames, both, want):
    p = spark.createDataFrame([("s", *pair)], "sequence_id string, t int, dist_temp int")
    got = windows.boundary_pairs(p, spark.createDataFrame([("s", frames)], "sequence_id string, n_frames int"), both).collect()
    assert [(r.t, r.t + r.dist_temp) for r in got] == want


def test_anchors_and_strides():
    assert windows.anchors([1, 2, 3], None) == [0] and windows.anchors([1], 0.5) == [0] and windows.anchors([1, 2, 3], 0.5) == [-1, 0, 1]
    assert windows.anchors([1, 2, 3], 1.0) == [-3, -2, -1, 0, 1, 2, 3] and windows.anchors([2, 4], 1.0) == [-4, -2, 0, 2, 4]
    assert edges.strides(2, 3) == [2, 4, 6] and edges.strides((1, 3), 2) == [1, 2, 3, 4, 6] and edges.strides((1, 7, 2), 1) == [1, 3, 5, 7]
    with pytest.raises(ValueError):
        edges.strides((1, 2, 3, 4), 1)


def tracks_table(spark, rows):
    return spark.createDataFrame([("s", i, *r, "original") for i, r in enumerate(rows)], "sequence_id string, index long, t int, label_track long, parent_track long, center_0 double, center_1 double, cell_source string")


def test_fill_gap(spark):
    got = correction.fill_gaps(tracks_table(spark, [(0, 1, 0, 6.0, 6.0), (2, 1, 0, 8.0, 8.0)])).where("t = 1").collect()
    assert [(r.center_0, r.center_1, r.cell_source, r["index"]) for r in got] == [(7.0, 7.0, "interpolated", 2)]


def test_split_at_gaps_follows_children(spark):
    t = tracks_table(spark, [(0, 1, 0, 0.0, 0.0), (3, 1, 0, 0.0, 0.0), (4, 2, 1, 0.0, 0.0), (4, 3, 1, 0.0, 0.0)])
    got = {(r.t, r.label_track, r.parent_track) for r in correction.split_at_gaps(t).collect()}
    assert got == {(0, 1, 0), (3, 4, 0), (4, 2, 4), (4, 3, 4)}


def test_violations(spark):
    t = tracks_table(spark, [(0, 1, 0, 0.0, 0.0), (1, 2, 1, 0.0, 0.0), (1, 3, 1, 0.0, 0.0), (2, 2, 1, 0.0, 0.0)])
    assert correction.violations(t).count() == 0
    bad = tracks_table(spark, [(0, 1, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0), (2, 2, 1, 0.0, 0.0), (4, 4, 9, 0.0, 0.0)])
    assert {(r.rule, r.label) for r in correction.violations(bad).collect()} >= {("gap", 1), ("daughters", 1), ("parent missing", 9), ("overlap", 1)}


def test_trajectories_and_lbep(spark):
    n = nodes_table(spark, [(i, t, 0, 0.0, 0.0) for i, t in enumerate([0, 1, 2, 2, 3, 0])])
    links = spark.createDataFrame([("s", 0, 1), ("s", 1, 2), ("s", 1, 3), ("s", 3, 4)], "sequence_id string, src long, dst long")
    got = {r["index"]: (r.start, r.parent) for r in lineage.trajectories(n, links).collect()}
    assert got == {0: (0, None), 1: (0, None), 2: (2, 0), 3: (3, 0), 4: (3, 0), 5: (5, None)}
    numbered = lineage.numbered_labels(lineage.trajectories(n, links))
    assert {(r["index"], r.label_track, r.parent_track) for r in numbered.collect()} == {(0, 1, 0), (1, 1, 0), (2, 2, 1), (3, 3, 1), (4, 3, 1), (5, 4, 0)}
    t = n.select("sequence_id", "index", "t").join(numbered, ["sequence_id", "index"])
    assert {(r.label, r.b, r.e, r.parent) for r in lbep(t).collect()} == {(1, 0, 1, 0), (2, 2, 2, 1), (3, 2, 3, 1), (4, 0, 0, 0)}


def test_matching_is_optimal_and_bridges():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = rng.integers(1, 6, 2)
        w = rng.integers(0, 50, (a, b)).astype(float)
        got = matching.hungarian(w)
        best = max(sum(w[i, j] for i, j in zip(r, c, strict=True)) for k in range(min(a, b) + 1) for r in itertools.combinations(range(a), k) for c in itertools.permutations(range(b), k))
        assert sum(w[i, j] for i, j in got) == best and len({i for i, _ in got}) == len(got) == len({j for _, j in got})


def test_link(spark):
    rows = [("s", 0, 0, 2, 0.95, 0.0, "correspondence"), ("s", 0, 1, 2, 0.9, 0.0, "correspondence"), ("s", 0, 1, 3, 0.7, 0.0, "correspondence"), ("s", 1, 2, 5, 0.1, 0.9, "division"), ("s", 1, 2, 6, 0.1, 0.8, "division"), ("s", 1, 2, 7, 0.1, 0.7, "division"), ("s", 1, 3, 8, 0.1, 0.6, "division")]
    df = spark.createDataFrame(rows, "sequence_id string, t int, src long, dst long, p1 double, p2 double, kind string")
    plain = {(r.src, r.dst, r.type) for r in matching.link(df).collect()}
    assert plain == {(0, 2, "correspondence"), (1, 3, "correspondence"), (2, 5, "division"), (2, 6, "division")}
    assert {(r.src, r.dst, r.type) for r in matching.link(df, rescue=True).collect()} == plain | {(3, 8, "correspondence")}


def test_links_that_span_the_same_components(spark):
    """Rounds of components went over all links; what a partition's links join is one link a node."""
    import random

    from trackweave.operators import components as cc

    draw = random.Random(5)
    rows = [(s, a, b) for s in ("s", "u") for g in range(6) for a, b in ((100 * g + draw.randrange(40), 100 * g + draw.randrange(40)) for _ in range(300 if g else 20))] + [("s", None, 3), ("s", 5, None), ("u", 900, 900)]
    df = spark.createDataFrame(rows, "sequence_id string, src long, dst long").repartition(3)
    whole = lambda links: sorted(tuple(r) for r in cc.components(links).collect())
    want, nodes = whole(df.where("src is not null and dst is not null")), {(s, x) for s, *ends in rows for x in ends if None not in ends}
    assert whole(cc.spanning(df)) == want and len({c for s, _, c in want if s == "u"}) > 5
    assert cc.spanning(df.coalesce(1)).count() == len(nodes) and cc.spanning(df).count() <= 3 * len(nodes)


def test_matching_of_a_stream(spark, monkeypatch):
    """Every frame looked through all divisions of its group; frames are folded as they come, however they are cut into batches."""
    import random

    draw = random.Random(2)
    rows = sorted(("s", deal, 3 * t, t + 1, 31, 100 * t + a, 100 * (t + draw.choice((1, 2))) + b, draw.random(), draw.random() < 0.6) for deal in (0, 1) for t in range(deal, 30) for a in range(6) for b in range(6) if draw.random() < 0.5)
    columns = [*"sequence_id deal t rank ranks src dst score division".split()]
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=columns)
    fold = lambda size: {tuple(r) for out in matching._stream(2, True)(pdf.iloc[a : a + size] for a in range(0, len(pdf), size)) for r in out.itertuples(index=False)}
    want = fold(len(pdf))
    assert len(want) > 100 and {k for *_, k in want} == {"correspondence", "division"} and all(fold(n) == want for n in (1, 7, 100))
    seen = []
    monkeypatch.setattr(matching._Matching, "frame", lambda self, c, d: seen.append(len(c) + len(d)) or [])
    fold(50)
    assert sum(seen) == len(pdf) and len(seen) == 59  # each candidate is looked at in its own frame alone


def test_predictions(spark):
    df = spark.createDataFrame([("s", 0, 1, 0.1, 0.5, 0.5), ("s", 0, 2, 0.9, 0.2, 0.6)], "sequence_id string, src long, dst long, p0 double, p1 double, p2 double")
    assert predictions.candidates(df, "correspondence", 0.3).count() == 1 and predictions.candidates(df, "division", 0.3).count() == 2
    assert predictions.candidates(df, "division", 0.3, False).count() == 1
    assert [r.c for r in df.select(predictions.argmax_class(df).alias("c")).collect()] == [1, 0]
    two = spark.createDataFrame([("s", 0, 1, 2.0), ("s", 1, 0, 4.0), ("s", 2, 3, 9.0)], "sequence_id string, src long, dst long, p0 double")
    assert [(r.src, r.dst, r.p0) for r in predictions.merge_directions(two).collect()] == [(0, 1, 3.0)]
    assert predictions.merge_directions(two.where("src < dst")).count() == 2


def test_one_vs_rest(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1, 2, 2], [0, 1, 1, 1, 0, 2, 1], strict=True)), "y int, y_pred int")
    got = {r["class"]: (r.tp, r.fp, r.fn, r.tn) for r in metrics.one_vs_rest(df, "y", "y_pred", 3).collect()}
    assert got[2] == (1, 0, 1, 5) and got[1][:3] == (2, 2, 1)


def test_sampling_mass(spark):
    sizes = spark.createDataFrame([("a", 10, 5), ("b", 90, 5)], "sequence_id string, size long, length long")
    mass = lambda alpha, floor: {r.sequence_id: round(r.mass, 6) for r in metrics.sampling_weights(sizes, alpha, floor).collect()}
    assert mass(0, 0) == {"a": 0.5, "b": 0.5} and mass(1, 0) == {"a": 0.1, "b": 0.9} and 0.1 < mass(0.5, 0)["a"] < 0.5 and mass(1, 0.3)["a"] > 0.2


def test_extreme_samples(spark):
    df = spark.createDataFrame([("s", *r) for r in zip([1, 2, 3, 3, 5], [2, 1, 4, 6, 7], [0, 0, 1, 1, 1], [8.0, 8.0, 4.0, 2.0, 0.5], strict=True)], "sequence_id string, src long, dst long, y int, loss double")
    got = predictions.extreme_samples(df, 2, 1).collect()
    assert sorted((r.y, r.src, r.loss) for r in got) == [(0, 1, 8.0), (1, 3, 4.0), (1, 5, 0.5)]


def square(t, label, y0, x0, n=5, m=5):
    return [("s", t, y, x, label, float(y * x % 7)) for y in range(y0, y0 + n) for x in range(x0, x0 + m)]


PIXELS = "sequence_id string, t int, y int, x int, label long, intensity double"


def test_pixels(spark):
    p = spark.createDataFrame(square(0, 1, 2, 2, 2, 2) + square(0, 2, 10, 10) + square(1, 2, 11, 10), PIXELS)
    got = {(r.t, r.label): r for r in pixels.region_properties(p).collect()}
    assert got[0, 1].area == 4 and (got[0, 1].centroid_0, got[0, 1].centroid_1) == (2.5, 2.5) and got[0, 1].bbox_2 == 4
    ids = spark.createDataFrame([("s", 0, 1, 0), ("s", 0, 2, 1), ("s", 1, 2, 2)], "sequence_id string, t int, label long, index long")
    over = edges.mask_overlap(p, ids, [1]).collect()
    assert [(r.src, r.dst, r.intersection, round(r.overlap, 2)) for r in over] == [(1, 2, 20, 0.8)]
    assert {(r.t, r.label): r.thickness for r in pixels.thickness(p).collect()}[0, 2] == 6.0
    apart = spark.createDataFrame(square(0, 1, 0, 0, 2, 2) + square(0, 1, 2, 2, 1, 1) + square(0, 1, 9, 9, 1, 1), PIXELS)
    assert [(r.part, r["size"]) for r in pixels.connected_parts(apart).orderBy("part").collect()] == [(0, 5), (1, 1)]


def test_message_passing(spark):
    n = spark.createDataFrame([("s", i, [float(i), 1.0]) for i in range(3)], "sequence_id string, index long, embedding array<double>")
    e = spark.createDataFrame([("s", 0, 2, [2.0, 4.0]), ("s", 1, 2, [4.0, 0.0]), ("s", 2, 0, [9.0, 9.0])], "sequence_id string, src long, dst long, message array<double>")
    got = {r["index"]: r.message for r in vectors.messages(e, n).collect()}
    assert got == {0: [9.0, 9.0], 1: [0.0, 0.0], 2: [3.0, 2.0]}
    aware = {r["index"]: r.features for r in vectors.time_aware_messages(e, n).collect()}
    assert aware[2] == [3.0, 2.0, 0.0, 0.0, 2.0, 1.0] and aware[0] == [0.0, 0.0, 9.0, 9.0, 0.0, 1.0]
    assert vectors.network(n, e, []) is n


def test_feature_names():
    have = ["area", "area_norm", "area_init", "center-0", "center-1", "intensity_mean", "intensity_max", "areal"]
    assert nodes.resolve_features(have, ["area", "center", "intensity"]) == ["area_norm", "center-0", "center-1", "intensity_max", "intensity_mean"]
    assert nodes.position_columns(["centroid_0", "centroid_1", "center_0_px", "center_1_px", "center_0"]) == ["center_0_px", "center_1_px"]
    with pytest.raises(ValueError):
        nodes.require(["a"], ["b"])


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "sequence_id string, index long, t int, label_track long, parent_track long, center_0 double, center_1 double, cell_source string")
    for f in (correction.fill_gaps, correction.split_at_gaps, correction.violations, correction.division_gaps, lineage.spans, lbep):
        assert f(none).count() == 0
    assert none.where(F.lit(True)).count() == 0


def test_centremost_and_channels(spark):
    from trackweave.operators.nodes import centremost
    from trackweave.operators.pixels import normalised_channels

    rows = [("s", 1, 7, 5, 4.0, 5.0), ("s", 1, 3, 9, 6.0, 5.0), ("s", 1, 1, 2, 0.0, 0.0), ("s", 2, 4, 4, None, 5.0)]
    nodes = spark.createDataFrame(rows, "sequence_id string, t int, index int, label int, center_0 double, center_1 double")
    assert [tuple(r) for r in centremost(nodes, 10, 10).collect()] == [("s", 1, 3, 9)]
    px = spark.createDataFrame([(0.485,), (None,)], "intensity double")
    got = [tuple(r) for r in normalised_channels(px).select("channel_0", "channel_1").collect()]
    assert got[0][0] == 0.0 and abs(got[0][1] - 0.029 / 0.224) < 1e-12 and got[1] == (None, None)


def test_graph_by_pairs(spark):
    from trackweave.operators.windows import frame_pairs

    rows = [("s", t * 10 + k, t, k, 0, float(10 * k + t), 0.0, 5.0) for t in range(6) for k in range(3)] + [("one", 0, 0, 1, 0, 0.0, 0.0, 5.0)]
    nodes = spark.createDataFrame(rows, "sequence_id string, index long, t int, label long, parent long, center_0 double, center_1 double, area double").withColumn("intensity_mean", F.lit(1.0))
    links = lambda **k: {(r.t, r.dist_temp) for r in edges.build_graph(nodes, [1, 3], 4.0, ["center_0", "center_1"], **k).where("dist_temp > 0").collect()}
    assert links() == links(connectivity="dense") == {(t, d) for t in range(6) for d in (1, 3) if t + d < 6}
    assert links(connectivity="sequential") == {(t, 1) for t in range(5)}
    assert links(at=1) == {(1, 1), (1, 3)} and links(at=1, connectivity="sequential") == {(1, 1), (2, 2)} and links(at=1, connectivity="dense") == {(1, 1), (1, 3), (2, 2)}
    assert links(at=4) == {(4, 1), (1, 3)} and links(at=5) == {(4, 1), (2, 3)}  # moved back by their stride
    assert links(at=5, bidirectional=False) == set()
    graph = edges.build_graph(nodes, [1], 0.5, ["center_0", "center_1"])
    with pytest.raises(edges.NoEdges, match="19 nodes"):
        edges.required(graph, nodes, 0.5)
    assert edges.required(edges.build_graph(nodes, [1], 4.0, ["center_0", "center_1"]), nodes, 4.0).count() == 30
    assert frame_pairs(nodes.select("sequence_id", "t").distinct(), [1]).count() == 7


def test_features_by_name_in_the_graph(spark, caplog):
    from trackweave.operators.registries import EDGE_PROPERTIES

    if "depth_step" not in EDGE_PROPERTIES:
        EDGE_PROPERTIES.add("depth_step")(lambda df: df.withColumn("depth_step", F.col("depth_dst") - F.col("depth_src")))
    rows = [("s", k, k, 1, 0, float(k), 0.0, 5.0, 1.0, float(k * k)) for k in range(4)]
    nodes = spark.createDataFrame(rows, "sequence_id string, index long, t int, label long, parent long, center_0 double, center_1 double, area double, intensity_mean double, depth double")
    links = edges.build_graph(nodes, [1], 2.0, ["center_0", "center_1"], bidirectional=False, features=("depth_step", "no such thing", "relative_size"), columns=("depth",))
    assert links.columns[-2:] == ["depth_step", "relative_size"] and sorted(r.depth_step for r in links.collect()) == [1.0, 3.0, 5.0]
    assert "no such thing" in caplog.text


def test_late_daughters(spark):
    """a daughter that comes late counts though her sister is in time, and says that the parent has no gap."""
    t = tracks_table(spark, [(0, 1, 0, 1.0, 1.0), (1, 2, 1, 1.0, 1.0), (4, 3, 1, 1.0, 1.0), (9, 4, 2, 1.0, 1.0)])
    got = sorted((r.label_track, r.parent, r.parent_last, r.first, r.parent_first) for r in correction.late_daughters(t).collect())
    assert got == [(3, 1, 0, 4, 1), (4, 2, 1, 9, 9)]
    assert [r.parent for r in correction.division_gaps(t).collect()] == [2]


def test_interpolation_returns_the_trajectories_too(spark):
    """the given rows and those of gaps of any width, 500 frames as well as 1."""
    from trackweave.plans import oracles, queries

    assert "range(1, 400)" not in oracles()["f33_interpolation"]
    data = "/root/testdata/sf0.001"
    got = queries()["f33_interpolation"](spark, data)
    assert {r.cell_source for r in got.select("cell_source").distinct().collect()} == {"original", "interpolated"}
    wide = correction.fill_gaps(tracks_table(spark, [(0, 1, 0, 0.0, 0.0), (501, 1, 0, 501.0, 0.0)]))
    assert wide.count() == 502 and wide.where("t = 450").first().center_0 == 450.0
