"""Lineage files, splits and the edge store."""

import pytest
from pyspark.sql import functions as F

from trackweave.sources import lineage_files as lf
from trackweave.sources.edge_store import EdgeStore, StoreMeta


def test_lineage_and_states(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 3, 0), (2, 4, 5, 1)], lf.LINEAGE)
    lf.write_lineage(rows, f"{tmp_path}/lbep")
    assert lf.read_lineage(spark, f"{tmp_path}/lbep").collect() == rows.collect()
    states = spark.createDataFrame([(1, 0, 2, 0, "009"), (1, 1, 3, 0, "9"), (1, 2, 1, 0, "9a")], lf.STATES)
    states.write.option("header", True).csv(f"{tmp_path}/states")
    assert sorted(r.state for r in lf.read_states(spark, f"{tmp_path}/states", 9).collect()) == [1, 2]
    assert [r.state for r in lf.read_states(spark, f"{tmp_path}/states", "9a").collect()] == [0]


def test_splits(spark):
    splits = {0: {"train": ["seq1", "seq2"], "val": ["seq3"]}, 1: {"train": ["seq4"], "val": ["seq5", "seq6"]}}
    assert lf.split_sequences(spark, splits, 0) == ["seq1", "seq2", "seq3"] and lf.split_sequences(spark, splits, 1, "val") == ["seq5", "seq6"]
    for fold, phase in ((99, None), (0, "test")):
        with pytest.raises(KeyError):
            lf.split_sequences(spark, splits, fold, phase)


def test_edge_store(spark, tmp_path):
    links = spark.createDataFrame([("s", s, s + k, 0, k, float(r)) for s in range(4) for k in (1, 2, 3) for r in (5, 15, 60)], "sequence_id string, src long, dst long, t int, dist_temp int, dist_spat double")
    asked = []

    def compute(strides, radius):
        asked.append((strides, radius))
        return links.where(F.col("dist_temp").isin(strides)).where(F.col("dist_spat") <= radius)

    store = EdgeStore(spark, f"file://{tmp_path}/store")
    assert store.get(StoreMeta(100.0, False, strides=[1, 2]), compute).count() == 24
    assert store.get(StoreMeta(20.0, False, strides=[1]), compute).count() == 8 and store.strides() == [1, 2]
    assert store.get(StoreMeta(20.0, False, strides=[1, 2, 3]), compute).count() == 24
    assert asked == [([1, 2], 100.0), ([3], 100.0)]
    assert store.get(StoreMeta(20.0, True, strides=[1]), compute).count() == 16 and asked[-1] == ([1], 20.0)
    assert store.get(StoreMeta(20.0, True, strides=[4]), compute).count() == 0 and 4 in store.meta().strides
    plan = store.scan([1], 20.0, False)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "PartitionFilters" in plan


def test_layout():
    from trackweave.sources import layout

    assert layout.sequences(["01", "01_GT", "02_GT", "03"], "ctc") == ["01", "03"]
    assert layout.sequences(["a_masks.tif", "a.tif", "b_masks.tiff", "c_mask.tif"], "flat") == ["a", "b"]
    assert layout.sequences([], "dirs", "masks", {"s1": ["masks.tif"], "s2": ["img"], "s3": ["masks"]}) == ["s1", "s3"]
    assert layout.mask_folder(["01_GT/SEG", "01_GT/TRA"], "01") == "01_GT/TRA" and layout.mask_folder([], "01") == "01"
    assert layout.find_lineage(["d/states.txt", "d/e/man_track.txt"], "d/e/f") == "d/states.txt"
    assert layout.find_lineage(["states.txt", "d/e/man_track.txt"], "d/e/f", "d") == "d/e/man_track.txt" and layout.find_lineage(["states.txt"], "d/e/f", "d/") is None
    assert layout.choose_checkpoint(["epoch=3.ckpt", "epoch=12.ckpt"]) == "epoch=12.ckpt" and layout.choose_checkpoint(["last.ckpt", "best.ckpt"]) == "best.ckpt"
    assert layout.shared_id("exp1_images.tif", "exp1_masks.tif") == "exp1" and layout.shared_id("a.tif", "b.tif") is None
    assert layout.results_exist(["s_tracks.csv", "s_tracks.tif"], "s", "flat") and not layout.results_exist(["s_tracks.csv"], "s", "flat") and layout.results_exist(["s_RES/x"], "s", "ctc")
    assert layout.spacing([1, 2, 3, 4])["x"] == 4.0 and layout.spacing({"z": 2})["t"] == 1.0
    with pytest.raises(ValueError):
        layout.spacing([1, 2])


def test_tiff(spark, tmp_path):
    import numpy as np

    from trackweave.sources import tiff

    rng = np.random.default_rng(1)
    stack = [rng.integers(0, 4, (7, 9)).astype(np.uint16) for _ in range(3)]
    for deflate in (True, False):
        assert all((a == b).all() for a, b in zip(stack, tiff.decode(tiff.encode(stack, deflate)), strict=True))
    (tmp_path / "seq").mkdir()
    for t, page in enumerate(stack):
        (tmp_path / "seq" / f"t{t:03d}.tif").write_bytes(tiff.encode([page]))
    pixels = tiff.read_pixels(spark, f"file://{tmp_path}/seq/*.tif")
    got = {(r.t, r.y, r.x): r.label for r in pixels.collect()}
    assert got == {(t, y, x): int(v) for t, page in enumerate(stack) for (y, x), v in np.ndenumerate(page) if v}
    files = tiff.frame_files(pixels, spark.createDataFrame([("seq", 7, 9)], "sequence_id string, height int, width int")).collect()
    assert all((tiff.decode(bytes(r.content))[0] == stack[r.t]).all() for r in files) and len(files) == 3
    with pytest.raises(ValueError):
        tiff.decode(b"PNG")


def test_node_cache(spark, tmp_path):
    from trackweave.sources import sinks

    nodes = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 3.0)], "sequence_id string, index long, area double")
    path = f"file://{tmp_path}/cache"
    assert sinks.read_nodes(spark, path, ["area"], {"t": 1.0}, "x") is None
    sinks.write_nodes(nodes, path, {"t": 1.0}, "x")
    assert sinks.read_nodes(spark, path, ["area"], {"t": 1.0}, "x").count() == 2
    assert sinks.read_nodes(spark, path, ["solidity"], {"t": 1.0}, "x") is None and sinks.read_nodes(spark, path, ["area"], {"t": 2.0}, "x") is None
    p = spark.createDataFrame([(float(k),) for k in range(101)], "intensity double")
    assert sinks.cached_percentiles(spark, f"{path}/p", p, 0.1, 0.9) == [10.0, 90.0] == sinks.cached_percentiles(spark, f"{path}/p", p.where("false"), 0.1, 0.9)
    shown = sinks.display_rows(spark.createDataFrame([(1, 0), (2, 1)], "label long, t int"), spark.createDataFrame([(2, 1)], "label long, parent long"))
    assert {(r.label, r.parent) for r in shown.collect()} == {(1, 0), (2, 1)}


def test_images_with_masks(spark, tmp_path):
    import numpy as np

    from trackweave.sources import tiff

    rng = np.random.default_rng(3)
    light, label = rng.integers(0, 999, (2, 5, 6)).astype(np.uint16), rng.integers(0, 3, (2, 5, 6)).astype(np.uint16)
    for kind, pages in (("masks", label), ("images", light), ("short", light[:1])):
        (tmp_path / kind / "01").mkdir(parents=True)
        (tmp_path / kind / "01" / "stack.tif").write_bytes(tiff.encode(list(pages)))
    path = lambda kind: f"file://{tmp_path}/{kind}/01"
    rows, found = tiff.read_sequence(spark, path("masks"), path("images"), f"file://{tmp_path}/p", 0.1, 0.9)
    assert {(r.t, r.y, r.x): (r.label, r.intensity) for r in rows.collect()} == {(t, y, x): (label[t, y, x], light[t, y, x]) for t in range(2) for y in range(5) for x in range(6)}
    assert np.allclose(found, np.quantile(light, [0.1, 0.9])) and tiff.read_sequence(spark, path("masks"), path("images"), f"file://{tmp_path}/p")[1] == found
    only, none = tiff.read_sequence(spark, path("masks"))
    assert none is None and only.columns == ["sequence_id", "t", "y", "x", "label"]
    with pytest.raises(ValueError, match="frame 1"):
        tiff.read_sequence(spark, path("masks"), path("short"))


def test_shared_folder(spark, monkeypatch):
    from trackweave import storage

    class Session:
        """A session without the setting."""

        def __init__(self, master):
            self.conf = type("Conf", (), {"get": lambda *a: None})()
            self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": lambda *a: None, "setCheckpointDir": lambda *a: None})()

    assert storage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert "trackweave" in storage.shared_folder(Session("local[4]"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            storage.shared_folder(Session(master))


def test_export_with_markers(spark, tmp_path):
    import numpy as np

    from trackweave.sources import image_source, sinks, tiff

    rows = [("s", i, t, label, up, y, x) for i, (t, label, up, y, x) in enumerate([(0, 1, 0, 2.0, 2.0), (4, 1, 0, 3.0, 3.0), (0, 2, 0, 2.0, 3.0), (4, 2, 0, 6.0, 6.0), (5, 3, 1, 3.0, 3.0)])]
    tracks = spark.createDataFrame(rows, "sequence_id string, index long, t int, label_track long, parent_track long, center_0 double, center_1 double")
    pixels = tracks.selectExpr("sequence_id", "t", "cast(center_0 as int) y", "cast(center_1 as int) x", "label_track as label").unionByName(spark.createDataFrame([("s", 2, 2, 2, 9), ("s", 2, 2, 3, 9)], "sequence_id string, t int, y int, x int, label long"))
    frames = spark.createDataFrame([("s", t, 8, 8) for t in range(7)], "sequence_id string, t int, height int, width int")
    sinks.export_ctc(tracks, pixels, frames, f"file://{tmp_path}")
    folder = tmp_path / "s_RES"
    assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == ["res_track.txt", *(f"t{t:03d}.tif" for t in range(7))]
    assert (folder / "res_track.txt").read_text().splitlines() == ["1 0 4 0", "2 0 4 0", "3 5 5 1"]
    pages = [tiff.decode((folder / f"t{t:03d}.tif").read_bytes())[0] for t in range(7)]
    # Frames 1 to 3 lack both; 1 goes first, and in frame 2 their places are taken.
    assert [(int(p[2, 2]), int(p[2, 3])) for p in pages] == [(1, 2), (1, 2), (9, 9), (1, 2), (0, 0), (0, 0), (0, 0)]
    assert [sorted(np.unique(p).tolist()) for p in pages] == [[0, 1, 2], [0, 1, 2], [0, 1, 2, 9], [0, 1, 2], [0, 1, 2], [0, 3], [0]]
    assert pages[2][1, 2] == 1
    image_source.register(spark)
    assert spark.read.format("tiff_pixels").load(str(folder)).where("t = 3").count() == 2
    full = spark.createDataFrame([("s", t, 1, 1) for t in range(7)], frames.schema)
    with pytest.raises(ValueError, match="no background"):
        sinks.with_markers(tracks, spark.createDataFrame([("s", 2, 0, 0, 9)], pixels.schema), full)
