"""Closing gaps that contend, by golden scenes and against a walk over whole arrays; progress and cancellation."""

import random
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_correction import TRACKS, masks_of, preds_of, tracks_of
from trackweave.operators import chain, correction, gap_repair, progress

PIXELS = "sequence_id string, t int, y int, x int, label long"


def state_of(spark, stack, rows, edges, images=None):
    """stack: (t, y, x) labels; rows: (index, t, label, parent, y, x)."""
    tracks = spark.createDataFrame([("s", i, t, label, up, float(y), float(x), "original") for i, t, label, up, y, x in rows], TRACKS)
    pixels = spark.createDataFrame([("s", int(t), int(y), int(x), int(stack[t, y, x])) for t, y, x in np.argwhere(stack >= 0)], PIXELS)
    return chain.State(tracks, pixels, preds_of(spark, edges or [(10**6, 10**6 + 1, 0.0, 0.0)]))


def stack_of(state, shape):
    out = np.zeros(shape, int)
    for r in state.pixels.collect():
        out[r.t, r.y, r.x] = r.label
    return out


def single_gap(other=None):
    stack = np.zeros((3, 40, 40), int)
    stack[0, 15:25, 15:25] = stack[2, 15:25, 15:25] = 1
    rows = [(0, 0, 1, 0, 20, 20), (1, 2, 1, 0, 20, 20)]
    if other:
        stack[1][other] = 2
        rows.append((2, 1, 2, 0, 20, 20))
    return stack, rows


@pytest.mark.parametrize("outcome", ["relabel", "remove", "draw over", "marker"])
def test_outcomes_of_a_conflict(spark, outcome):
    wide = outcome in ("draw over", "marker")
    stack, rows = single_gap((slice(15, 25), slice(22, 35)) if wide else (slice(17, 23), slice(17, 23)))
    edges = [(2, 1, 0.9 if outcome == "relabel" else 0.2, 0.0)] + ([(2, 77, 0.8, 0.0)] if outcome == "marker" else [])
    state = state_of(spark, stack, rows, edges)
    done = chain.close_gaps(resolve=True)(state)
    made, got = done.tracks.where("t = 1").orderBy("label_track").collect(), stack_of(done, stack.shape)[1]
    sizes = ((got == 1).sum(), (got == 2).sum())
    says = [(r.label_track, r.cell_source) for r in made]
    if outcome == "relabel":
        assert sizes == (36, 0) and says == [(1, "original")]
    elif outcome == "remove":
        assert sizes == (100, 0) and says == [(1, "interpolated")]
    elif outcome == "draw over":
        assert sizes == (100, 100) and says == [(1, "interpolated"), (2, "original")]
    else:
        assert sizes == (1, 130) and says == [(1, "interpolated_marker"), (2, "original")]
        assert got[20, 20] == 1 and (20.0, 20.0) == (made[0].center_0, made[0].center_1)
    # Where conflicts are skipped the frame stays as it is.
    left = chain.close_gaps()(state)
    assert left.tracks.count() == 3 and (stack_of(left, stack.shape) == stack).all()


def test_a_mask_that_would_break_gets_a_marker(spark):
    stack, rows = single_gap()
    stack[1, 19:21, 5:35] = 2  # the copy would cut this bar in the middle
    stack[0, 18:22, 18:22], stack[2, 18:22, 18:22] = 1, 1
    stack[0][stack[0] == 1] = 0
    stack[0, 17:23, 17:23] = 1
    rows.append((2, 1, 2, 0, 20, 20))
    done = chain.close_gaps(resolve=True)(state_of(spark, stack, rows, []))
    got = stack_of(done, stack.shape)[1]
    assert (got == 2).sum() == 60 and (got == 1).sum() == 1
    loose = chain.close_gaps(resolve=True, fragment=0.6)(state_of(spark, stack, rows, []))
    assert (stack_of(loose, stack.shape)[1] == 1).sum() == 36


def test_established_cells_are_not_touched(spark):
    stack, rows = single_gap((slice(17, 23), slice(17, 23)))
    for change in ("parent", "daughter", "longer"):
        more, mine = list(rows), stack.copy()
        if change == "parent":
            more[-1] = (2, 1, 2, 9, 20, 20)
        elif change == "daughter":
            more += [(3, 2, 3, 2, 2, 2)]
            mine[2, 1:3, 1:3] = 3
        else:
            more += [(3, 2, 2, 0, 2, 2)]
            mine[2, 1:3, 1:3] = 2
        done = chain.close_gaps(resolve=True)(state_of(spark, mine, more, []))
        got = stack_of(done, mine.shape)
        assert (got[1] == 2).sum() == 36 and (got[1] == 1).sum() == 1, change


def flood(mask):
    """8-connected parts as boolean arrays, in row order."""
    left, found = mask.copy(), []
    while left.any():
        grown = np.zeros_like(mask)
        grown[tuple(np.argwhere(left)[0])] = True
        while True:
            wide = np.pad(grown, 1)
            near = sum(wide[1 + a : wide.shape[0] - 1 + a, 1 + b : wide.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)).astype(bool) & mask
            if (near == grown).all():
                break
            grown = near
        found.append(grown)
        left &= ~grown
    return found


def walked(stack, rows, edges, rules, most):
    """The whole sequence gap after gap on arrays; markers at the end, by label in each frame."""
    stack = stack.copy()
    frames_of, index_of = {}, {}
    for i, t, label, *_ in rows:
        frames_of.setdefault(label, []).append(t)
        index_of[label, t] = i
    parents = {r[2]: r[3] for r in rows}
    filled, markers = set(), []
    score = {}
    for src, dst, p1, _ in edges:
        score.setdefault(src, {})[dst] = max(p1, score.get(src, {}).get(dst, 0))
    for label in sorted(frames_of):
        ts = sorted(frames_of[label])
        for before, after in zip(ts, ts[1:], strict=False):
            if not 1 < after - before <= most + 1:
                continue
            for t in range(before + 1, after):
                copy = stack[before] == label
                if (stack[t] == label).any() or not copy.any():
                    continue
                ratio, against = {}, []
                for o in np.unique(stack[t][copy]):
                    if o:
                        m = stack[t] == o
                        ratio[o] = (m & copy).sum() / m.sum()
                        if max(ratio[o], (m & copy).sum() / (m | copy).sum()) > rules.overlap:
                            against.append(o)
                action = "draw" if not against else "mark" if rules.resolve else None
                for o in against if rules.resolve else []:
                    at = frames_of.get(o, [])
                    if not at or min(at) <= before or max(at) >= after or parents[o] > 0 or o in parents.values():
                        continue
                    mine = {index_of[o, k] for k in at}
                    to_next = max((score.get(i, {}).get(index_of[label, after], 0) for i in mine), default=0)
                    best = max((p for i in mine for p in score.get(i, {}).values()), default=0)
                    if to_next > rules.link and to_next >= best:
                        stack[stack == o] = label
                        filled.add(("relabel", None, int(o)))
                        action = None
                        break
                    outside = any(max(p1, p2) > rules.link and (a in mine) != (b in mine) for a, b, p1, p2 in edges)
                    if outside:
                        continue
                    if ratio[o] > rules.covered:
                        stack[stack == o] = 0
                        filled.add(("remove", None, int(o)))
                        action = "draw"
                        break
                    if ratio[o] > rules.overlap:
                        sizes = [p.sum() for p in flood((stack[t] == o) & ~copy)]
                        if len(sizes) < 2 or min(sizes) / sum(sizes) <= rules.fragment:
                            action = "draw"
                            break
                if action == "draw":
                    stack[t][max(flood(copy), key=np.sum)] = label
                    filled.add(("copy", t, label))
                elif action == "mark":
                    markers.append((t, label))
    return stack, filled, sorted(markers)


def scene(seed):
    """Many cells on a small field, with gaps and brief masks in the way."""
    rnd = random.Random(seed)
    stack, rows, index = np.zeros((8, 30, 30), int), [], 0
    for label in range(1, 26):
        brief = label % 3 == 0
        first = rnd.randrange(1, 6) if brief else 0
        last = min(7, first + rnd.randrange(0, 2)) if brief else 7
        y, x, h, w = rnd.randrange(24), rnd.randrange(24), rnd.randrange(2, 7), rnd.randrange(2, 7)
        holes = set() if brief else set(rnd.sample(range(1, 7), 3))
        for t in range(first, last + 1):
            if t in holes:
                continue
            free = np.zeros((30, 30), bool)
            free[y : y + h, x : x + w] = True
            free &= stack[t] == 0
            if free.any():
                stack[t][free] = label
                rows.append((index, t, label, 0, y + h / 2, x + w / 2))
                index += 1
    edges = []
    for _ in range(60):
        a, b = rnd.sample(range(index), 2)
        edges.append((a, b, rnd.choice([0.2, 0.6, 0.9]), 0.0))
    briefs = [r for r in rows if r[2] % 3 == 0]
    for r in briefs[::2]:
        later = [q[0] for q in rows if q[2] % 3 and q[1] > r[1]]
        if later:
            edges.append((r[0], rnd.choice(later), 0.95, 0.0))
    return stack, rows, sorted(set(edges))


@pytest.mark.parametrize("seed", [1, 2])
def test_folded_groups_equal_a_walk_over_the_sequence(spark, seed):
    stack, rows, edges = scene(seed)
    state = state_of(spark, stack, rows, edges)
    rules, most = gap_repair.Rules(), 2
    want, filled, markers = walked(stack, rows, edges, rules, most)
    found = gap_repair.detection_gaps(state.tracks, most)
    made = gap_repair.contended(state, found, rules).collect()
    assert {(r.kind, r.t, r.label) for r in made if r.kind in ("copy", "relabel", "remove")} == filled
    assert sorted((r.t, r.label) for r in made if r.kind == "marker") == markers
    got = stack.copy()
    for r in made:
        if r.kind == "pixel":
            got[r.t, r.y, r.x] = r.label
    assert (got == want).all()
    done = gap_repair.repaired(state, found, rules)
    after = stack_of(done, stack.shape)
    assert (after != want).sum() == len(markers) and {(int(t), int(after[t, y, x])) for t, y, x in np.argwhere(after != want)} == set(markers)
    assert {k for k, _, _ in filled} >= {"copy"} and len(filled) > 10
    names = done.tracks.groupBy("label_track", "t").count().where("count > 1").count()
    assert names == 0 and done.tracks.count() == done.tracks.select("index").distinct().count()


def test_components_are_folded_one_after_the_other(spark):
    """Many in a batch, and one that several batches hold, give what each gives by itself."""
    own = [(c, kind, 10 * c + 1, t, end, y, 3, 0, 0.0, False, False) for c in range(1, 8) for kind, t, end, y in [("gap", 0, 2, 0), *(("pixel", 0, 0, y) for y in range(c))]]
    names = [gap_repair.SEQ, "component", "kind", "label", "t", "next_t", "y", "x", "other", "score", "lone", "strong"]
    pdf = pd.DataFrame([("s", *r) for r in own], columns=names)
    fold = gap_repair._fold_rows(gap_repair.Rules())
    one = pd.concat(list(fold(iter(g for _, g in pdf.groupby("component"))))).reset_index(drop=True)
    assert (one["kind"] == "copy").sum() == 7 and (one["kind"] == "pixel").sum() == 28
    for size in (1, 2, 3, 5, 100):
        got = pd.concat(list(fold(iter(pdf.iloc[k : k + size] for k in range(0, len(pdf), size))))).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, one)


def test_labels_beyond_what_a_double_holds(spark):
    stack, rows = single_gap((slice(17, 23), slice(17, 23)))
    big = 2**53 + 1
    stack[stack == 2] = big
    rows[-1] = (2, 1, big, 0, 20, 20)
    done = chain.close_gaps(resolve=True)(state_of(spark, stack, rows, [(2, 1, 0.9, 0.0)]))
    assert [(r.label_track, r.cell_source) for r in done.tracks.where("t = 1").collect()] == [(1, "original")]


def test_the_detection_gate(spark):
    stack, rows = single_gap()
    rng = np.random.default_rng(0)
    images = rng.normal(100, 4, stack.shape)
    for t in (0, 2):
        images[t, 15:25, 15:25] = rng.normal(100, 60, (10, 10))
    for flat in (True, False):
        images[1, 15:25, 15:25] = 100 if flat else rng.normal(100, 60, (10, 10))
        light = spark.createDataFrame([("s", t, y, x, float(v)) for (t, y, x), v in np.ndenumerate(images)], "sequence_id string, t int, y int, x int, intensity double")
        state = state_of(spark, stack, rows, [])
        done = chain.close_gaps(resolve=True, images=light)(state)
        assert done.tracks.count() == (2 if flat else 3)
    cut = chain.split_leftover_gaps(state)
    assert cut.tracks.select("label_track").distinct().count() == 2


def test_divisions_with_a_gap(spark):
    t = tracks_of(spark, {1: (0, 0, 2, (10, 10)), 2: (1, 3, 8, (10, 20)), 3: (1, 6, 8, (20, 20))})
    # The first daughter follows at once: nothing to extend.
    assert correction.division_gaps(t).count() == 0
    blocked = tracks_of(spark, {1: (0, 0, 2, (10, 10)), 2: (1, 5, 8, (10, 20)), 3: (1, 5, 8, (20, 20)), 9: (0, 0, 8, (10, 30))})
    pixels = masks_of(blocked).unionByName(spark.createDataFrame([("s", 3, y, x, 9) for y in (10, 11) for x in (10, 11)], PIXELS))
    none = preds_of(spark, [(0, 1, 0.5, 0.0)])
    done = chain.close_division_gaps()(chain.State(blocked, pixels, none))
    rows = {r.t: r for r in done.tracks.where("label_track = 1 and t > 2").collect()}
    assert rows[3].cell_source == "interpolated_marker" and rows[4].cell_source == "interpolated"
    assert (rows[3].center_0, rows[3].center_1) == pytest.approx((10 + 5 / 3, 10 + 10 / 3))
    assert done.pixels.where("label = 1 and t = 3").count() == 1 and done.pixels.where("label = 9 and t = 3").count() == 8
    assert correction.violations(done.tracks, done.pixels).count() == 0


def test_broken_sequences_keep_what_was_given(spark):
    good = tracks_of(spark, {1: (0, 0, 9, (10, 10))}, {(1, 4)}).withColumn("sequence_id", F.lit("a"))
    bad = tracks_of(spark, {1: (0, 0, 3, (10, 10)), 2: (1, 4, 9, (10, 10)), 3: (1, 4, 9, (20, 10)), 4: (1, 4, 9, (30, 10)), 5: (0, 0, 9, (40, 40))}, {(5, 4)}).withColumn("sequence_id", F.lit("b"))
    t = good.union(bad)
    given = chain.State(t, masks_of(t), preds_of(spark, [(0, 1, 0.5, 0.0)]))
    done = chain.correct(given)
    count = lambda s: {r.sequence_id: r["count"] for r in s.tracks.groupBy("sequence_id").count().collect()}
    assert count(done) == {"a": 10, "b": count(given)["b"]}  # three daughters of one parent break a rule


def test_progress_and_cancellation(spark):
    t = tracks_of(spark, {1: (0, 0, 3, (10, 10))})
    given = chain.State(t, masks_of(t), preds_of(spark, [(0, 1, 0.5, 0.0)]))
    said = []
    slow_began = threading.Event()

    def first(state):
        return state

    def second(state):
        slow_began.set()
        slow = F.udf(lambda x: __import__("time").sleep(60) or x, "int")
        return chain.replace(state, tracks=state.tracks.withColumn("t", slow("t")))

    watched = progress.Progress(lambda *a: said.append(a))
    stopper = threading.Thread(target=lambda: (slow_began.wait(), __import__("time").sleep(3), watched.cancel()))
    stopper.start()
    began = __import__("time").time()
    with pytest.raises(progress.Cancelled):
        chain.correct(given, [first, second, first], watched)
    stopper.join()
    assert __import__("time").time() - began < 40
    names = [name for name, *_ in said]
    assert len(said) == 3 and names[0] != "" and [d for _, d, _ in said] == [0, 1, 1] and {n for *_, n in said} == {3}
    with pytest.raises(progress.Cancelled):
        chain.correct(given, [first], watched)
