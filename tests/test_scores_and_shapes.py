"""Tracking scores by type of error, exact quantiles, parts by runs, and distances in linear memory."""

import math
import random
import tracemalloc

import numpy as np
import pytest

from tests.test_correction import TRACKS, masks_of, tracks_of
from trackweave.operators import crops, pixels, quantiles, scores


def quality(spark, truth, found, truth_px=None, found_px=None):
    (row,) = scores.tracking_quality((truth, masks_of(truth) if truth_px is None else truth_px), (found, masks_of(found) if found_px is None else found_px)).collect()
    return row


TRUTH = {1: (0, 0, 3, (10, 10)), 2: (1, 4, 7, (10, 10)), 3: (1, 4, 7, (10, 20)), 4: (0, 0, 7, (30, 30))}


def test_a_perfect_result(spark):
    t = tracks_of(spark, TRUTH)
    row = quality(spark, t, t.replace({1: 11, 2: 12, 3: 13, 4: 14}, subset=["label_track", "parent_track"]))
    assert (row.det, row.lnk, row.tra, row.valid) == (1.0, 1.0, 1.0, True) and (row.nodes, row.links) == (20, 18)


@pytest.mark.parametrize("kind", ["missing", "spurious", "splits", "redundant_links", "missing_links", "wrong_links", "nothing"])
def test_each_type_of_error(spark, kind):
    truth = tracks_of(spark, TRUTH)
    spans, px, missing = dict(TRUTH), None, ()
    if kind == "missing":
        missing = {(4, 7)}
    elif kind == "spurious":
        spans[9] = (0, 3, 3, (50, 50))
    elif kind == "missing_links":
        spans |= {4: (0, 0, 3, (30, 30)), 8: (0, 4, 7, (30, 30))}
    elif kind == "redundant_links":
        spans |= {4: (3, 0, 7, (30, 30))}  # a parent that it has not: 3 ends in frame 7
    elif kind == "wrong_links":
        spans |= {4: (0, 0, 3, (30, 30)), 8: (4, 4, 7, (30, 30))}
    found = tracks_of(spark, spans, missing)
    if kind == "splits":  # 2 and 3 are one mask in frame 5
        found = tracks_of(spark, TRUTH, {(3, 5)})
        px = masks_of(tracks_of(spark, TRUTH)).replace({3: 2}, subset=["label"]).where("t = 5").unionByName(masks_of(found).where("t != 5"))
    if kind == "nothing":
        found = found.limit(0)
    row = quality(spark, truth, found, None, px)
    names = ["missing", "spurious", "splits", "redundant_links", "missing_links", "wrong_links"]
    got = {n: row[n] for n in names if row[n]}
    whole = 10 * 20 + 1.5 * 18
    want = {
        "missing": ({"missing": 1, "missing_links": 1}, 11.5), "spurious": ({"spurious": 1}, 1), "missing_links": ({"missing_links": 1}, 1.5), "redundant_links": ({"redundant_links": 1}, 1), "wrong_links": ({"wrong_links": 1}, 1),
        "splits": ({"splits": 1, "missing_links": 4, "redundant_links": 1}, 5 + 6 + 1), "nothing": ({"missing": 20, "missing_links": 18}, whole),
    }[kind]
    assert got == want[0] and row.tra == pytest.approx(1 - want[1] / whole)


def test_quantiles(spark):
    rnd = random.Random(2)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(3000)] + [("b", float(rnd.randrange(4))) for _ in range(1000)] + [("c", 5.0)] + [(None, x) for x in (1.0, 2.0, None, float("nan"))] + [("d", None)]
    rows += [("e", x) for x in (-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324)] + [("f", 1e9 + i * 1e-7) for i in range(500)]
    parts = [0.0, 0.0005, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: (r.n, r.q) for r in quantiles.quantiles(spark.createDataFrame(rows, "k string, v double"), "v", parts, ["k"]).collect()}
    keys = {k for k, v in rows if v is not None and not math.isnan(v)}
    assert set(got) == keys
    for k in keys:
        own = np.array([v for o, v in rows if o == k and v is not None and not math.isnan(v)])
        assert got[k][0] == len(own)
        if k != "e":
            assert np.allclose(got[k][1], np.quantile(own, parts), rtol=1e-12, atol=1e-300)
    assert got["e"][1][0] == -1.7e308 and got["e"][1][3] == 0.0 and got["e"][1][5] == 1.7e308
    (whole,) = quantiles.quantiles(spark.createDataFrame(rows[:3000], "k string, v double"), "v", [0.5]).collect()
    assert whole.q[0] == pytest.approx(np.median([v for _, v in rows[:3000]]))
    assert quantiles.quantiles(spark.createDataFrame([], "k string, v double"), "v", [0.5]).collect() == []


def components_of(points):
    left, out = set(points), []
    while left:
        start = min(left)
        stack, part = [start], set()
        left.discard(start)
        while stack:
            y, x = stack.pop()
            part.add((y, x))
            for n in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in left:
                    left.discard(n)
                    stack.append(n)
        out.append(part)
    return out


def test_parts_by_runs(spark):
    rnd = random.Random(4)
    rows = [("s", t, y, x, rnd.choice([0, 1, 1, 2])) for t in range(2) for y in range(25) for x in range(25)] + [("s", 5, i, (i * 7) % 50 // 2, 9) for i in range(50)]
    rows += [("s", 6, y, x, 3) for y in range(40) for x in range(40) if y % 4 < 2 or x == (y // 4 % 2) * 39]  # a winding band
    got = sorted((r.t, r.label, r.part, r["size"]) for r in pixels.connected_parts(spark.createDataFrame(rows, "sequence_id string, t int, y int, x int, label long")).collect())
    want = []
    for t, label in {(r[1], r[4]) for r in rows if r[4]}:
        parts = components_of([(r[2], r[3]) for r in rows if r[1] == t and r[4] == label])
        want += [(t, label, k, len(p)) for k, p in enumerate(sorted(parts, key=lambda p: (-len(p), min(p))))]
    assert got == sorted(want)


def test_distances(spark):
    rng = np.random.default_rng(1)
    for shape, part in (((20, 31), 0.02), ((1, 9), 0.3), ((9, 1), 0.3), ((33, 20), 0.5)):
        mask = rng.random(shape) < part
        mask.flat[3] = True
        ys, xs = np.nonzero(mask)
        y, x = np.mgrid[: shape[0], : shape[1]]
        want = np.sqrt(((y[..., None] - ys) ** 2 + (x[..., None] - xs) ** 2).min(-1))
        assert np.allclose(crops.distance_to(mask), want)
    tracemalloc.start()
    big = np.zeros((2000, 2000), bool)
    big[0], big[-1], big[:, 0], big[:, -1] = True, True, True, True
    far = crops.distance_to(big)
    assert far.max() == pytest.approx(999) and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_thickness(spark):
    rng = np.random.default_rng(2)
    mask = rng.random((24, 24)) < 0.9
    mask[8:20, 5:22] = True
    rows = [("s", 0, int(y), int(x), 7) for y, x in np.argwhere(mask)] + [("s", 0, int(y), int(x), 8) for y, x in np.argwhere(~mask)][:3]
    got = {r.label: r.thickness for r in pixels.thickness(spark.createDataFrame(rows, "sequence_id string, t int, y int, x int, label long")).collect()}
    assert got[7] == pytest.approx(2 * crops.distance_to(np.pad(~mask, 1, constant_values=True)).max()) and got[8] >= 2


def test_scores_have_a_schema(spark):
    none = spark.createDataFrame([], TRACKS)
    assert scores.tracking_quality((none, masks_of(none)), (none, masks_of(none))).collect() == []


def test_volumes(spark):
    from trackweave.operators.edges import radius_join

    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    at = np.stack(np.mgrid[0:40, 0:40, 0:40], -1).reshape(-1, 3)
    inside = (((at - 19.5) @ turn / np.array([15.0, 9.0, 5.0])) ** 2).sum(1) <= 1
    ball, lone, line = at[inside], np.array([[3, 4, 5]]), np.array([[1, 1, k] for k in range(7)])
    rows = [("s", 0, *map(int, p), label) for label, points in ((1, ball), (2, lone), (3, line)) for p in points]
    got = {r.label: r for r in pixels.region_properties_3d(spark.createDataFrame(rows, "sequence_id string, t int, z int, y int, x int, label long")).collect()}
    for label, points in ((1, ball), (2, lone), (3, line)):
        values = np.linalg.eigvalsh(np.atleast_2d(np.cov(points.T, bias=True)) if len(points) > 1 else np.zeros((3, 3)))
        r = got[label]
        assert r.area == len(points) and [r[f"bbox_{i}"] for i in range(6)] == [*points.min(0), *(points.max(0) + 1)] and np.allclose([r[f"centroid_{i}"] for i in range(3)], points.mean(0))
        assert r.axis_major_length == pytest.approx(math.sqrt(20 * values[2]), abs=1e-6) and r.axis_minor_length == pytest.approx(math.sqrt(20 * max(values[0], 0)), abs=1e-5)
    assert got[1].axis_major_length == pytest.approx(30, rel=0.03) and got[1].axis_minor_length == pytest.approx(10, rel=0.03)
    nodes = spark.createDataFrame([("s", 0, 0, 0.0, 0.0, 0.0), ("s", 1, 1, 3.0, 4.0, 0.0), ("s", 2, 1, 3.0, 4.0, 12.0)], "sequence_id string, index long, t int, center_0 double, center_1 double, center_2 double")
    near = [(r.src, r.dst, r.dist_spat) for r in radius_join(nodes, [1], 6.0, ["center_0", "center_1", "center_2"]).collect()]
    assert near == [(0, 1, 5.0)]
