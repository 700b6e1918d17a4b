"""Crop boxes by mode, padding and smoothing against numpy on small hand-made tables; planes of volumes."""

import numpy as np
import pytest

from trackweave.operators import crops, nodes

NODES = [("s", 1, 10.7, 3.2, 8, 1, 14, 6, 7.9), ("s", 2, 1.0, 18.0, 0, 15, 4, 20, 5.0), ("s", 3, 15.0, 10.0, 12, 2, 19, 19, 40.0), ("r", 4, 5.5, 5.5, 5, 5, 6, 6, 0.4), ("r", 5, None, 5.0, 5, 5, 6, 6, None)]
NAMES = "sequence_id string, index long, center_0 double, center_1 double, bbox_0 int, bbox_1 int, bbox_2 int, bbox_3 int, axis_major_length double"
FRAME = (20, 20)


def want(side, y, x, shift):
    side, out = int(side), []
    for c, most in ((y, FRAME[0]), (x, FRAME[1])):
        low = int(c) - side // 2
        if shift:
            low = min(max(low, 0), most - side)
        out.append((low, low + side, min(max(low, 0), most), min(max(low + side, 0), most)))
    (a, b, sa, sb), (c, d, sc, sd) = out
    return [side, a, c, b, d, sa, sc, sb, sd, sa - a, sc - c, sb - a, sd - c, sb - sa != side or sd - sc != side]


@pytest.mark.parametrize("shift", [True, False])
@pytest.mark.parametrize("mode", ["fixed", "bbox", "axis_major_length", "median_size"])
def test_sized_boxes(spark, mode, shift):
    df = spark.createDataFrame(NODES, NAMES)
    got = {r["index"]: r for r in nodes.sized_boxes(df, FRAME, mode, 1.5, side=7, shift=shift).collect()}
    medians = {"s": np.median([7.9, 5.0, 40.0]), "r": 0.4}
    columns = ["side", *(f"{k}_{i}" for k in ("crop", "src", "dst") for i in range(4)), "padded"]
    for seq, index, y, x, b0, b1, b2, b3, length in NODES:
        if y is None and mode != "bbox":
            assert got[index].crop_0 is None and got[index].src_0 is None and got[index].padded is None
            continue
        if mode == "bbox":
            y, x = (b0 + b2) // 2, (b1 + b3) // 2
        side = {"fixed": 7, "bbox": max(b2 - b0, b3 - b1) * 1.5, "axis_major_length": (length or 0) * 1.5, "median_size": medians[seq] * 1.5}[mode]
        assert [got[index][c] for c in columns] == want(side, y, x, shift), (mode, index)


def test_sized_boxes_of_volumes_take_the_plane(spark):
    given = spark.createDataFrame([("s", 1, 2.9, 6.0, 7.0, 0, 4, 5, 3, 9, 10)], "sequence_id string, index long, centroid_0 double, centroid_1 double, centroid_2 double, " + ", ".join(f"bbox_{i} int" for i in range(6)))
    row = nodes.sized_boxes(given, FRAME, "len_init", centre="centroid").collect()[0]
    assert (row.z, row.side, row.crop_0, row.crop_1) == (2, 5, 4, 5)
    voxels = spark.createDataFrame([("s", 0, z, y, x, 1, float(100 * z + y)) for z in range(4) for y in range(3, 10) for x in range(4, 12)], "sequence_id string, t int, z int, y int, x int, label long, intensity double")
    boxes = spark.createDataFrame([("s", 0, 1, 1, 2, 4, 5, 5)], "sequence_id string, t int, index long, label long, z int, crop_0 int, crop_1 int, side int")
    patch = np.reshape(crops.crops(voxels, boxes, 5).collect()[0].patch, (5, 5))
    assert patch[:, 0].tolist() == [204.0, 205.0, 206.0, 207.0, 208.0]


def test_sized_boxes_name_what_is_wrong(spark):
    df = spark.createDataFrame(NODES, NAMES)
    for kwargs, said in (({"mode": "area"}, "unknown mode"), ({"mode": "fixed"}, "needs a side"), ({"mode": "len_init"}, "len_init"), ({"centre": "centroid"}, "centroid_0")):
        with pytest.raises(ValueError, match=said):
            nodes.sized_boxes(df, FRAME, **kwargs)
    lengths = {r["index"]: r.side for r in nodes.sized_boxes(df, FRAME, "axis_major_length", spacing=(1.0, 0.5, 0.5)).collect()}
    assert lengths[1] == 15 and lengths[2] == 10
    assert nodes.sized_boxes(df.limit(0), FRAME, "median_size").count() == 0


@pytest.mark.parametrize("pad", crops.PADS)
def test_padding_as_the_array_library_has_it(spark, pad):
    image = np.random.default_rng(3).random((9, 9))
    px = spark.createDataFrame([("s", 0, y, x, 1, float(image[y, x])) for y in range(9) for x in range(9)], "sequence_id string, t int, y int, x int, label long, intensity double")
    boxes = spark.createDataFrame([("s", 0, 1, 1, -2, 4, 8), ("s", 0, 2, 1, 6, -5, 6)], "sequence_id string, t int, index long, label long, crop_0 int, crop_1 int, side int")
    got = {r["index"]: np.reshape(r.patch, (8 if r["index"] == 1 else 6, -1)) for size, at in ((8, 1), (6, 2)) for r in crops.crops(px, boxes.where(f"index = {at}"), size, pad, smooth=True).collect()}
    assert np.allclose(got[1], np.pad(image[:6, 4:], ((2, 0), (0, 3)), mode=pad))
    assert np.allclose(got[2], np.pad(image[6:, :1], ((0, 3), (5, 0)), mode=pad))


def test_smoothing_uses_every_pixel():
    for old, new in ((9, 4), (64, 7), (5, 5), (4, 9), (1, 3), (3, 1)):
        weights = crops.smoothing(old, new)
        assert weights.shape == (new, old) and np.allclose(weights.sum(1), 1)
        assert (weights.sum(0) > 0).all()
        if new >= old:
            image = np.random.default_rng(old).random((old, old))
            assert np.allclose(crops.smoothed(image, new), crops.resized(image, new))
    assert np.allclose(crops.smoothing(8, 4)[1], np.array([0, 1, 3, 3, 1, 0, 0, 0]) / 8)
