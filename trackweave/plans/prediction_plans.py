"""Plans over predictions and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.operators import metrics as m
from trackweave.operators import predictions as p
from trackweave.operators.windows import near_pairs
from trackweave.plans.ddb import r, sql
from trackweave.plans.registry import plan
from trackweave.sources import adapters as a

AVERAGED = "averaged AS (SELECT sequence_id, src, dst, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2, min(y) AS y, min(dataloader_idx) AS dataloader_idx FROM {0} GROUP BY sequence_id, src, dst)"
P = ", ".join(r(f"p{k}", f"p{k}") for k in range(3))
SOFT = "soft AS (SELECT *, e0 / (e0 + e1 + e2) AS s0, e1 / (e0 + e1 + e2) AS s1, e2 / (e0 + e1 + e2) AS s2 FROM (SELECT *, exp(p0 - greatest(p0, p1, p2)) AS e0, exp(p1 - greatest(p0, p1, p2)) AS e1, exp(p2 - greatest(p0, p1, p2)) AS e2 FROM preds))"


def _soft(spark, d):
    return p.with_softmax(a.preds(spark, d))


@plan("a1_average_duplicates", sql(f"+{AVERAGED.format('preds')} SELECT sequence_id, src, dst, {P}, y, dataloader_idx FROM averaged", "preds"))
def _a1(spark, d):
    return p.average_duplicates(a.preds(spark, d))


MERGED = f"""{AVERAGED.format('dense_preds')}, merged AS (SELECT f.sequence_id, f.src, f.dst, (f.p0 + b.p0) / 2 AS p0, (f.p1 + b.p1) / 2 AS p1, (f.p2 + b.p2) / 2 AS p2, f.y, f.dataloader_idx
  FROM averaged f JOIN averaged b ON b.sequence_id = f.sequence_id AND b.src = f.dst AND b.dst = f.src WHERE f.src < f.dst)"""


@plan("j13_merge_directions", sql(f"+{MERGED} SELECT sequence_id, src, dst, {P}, y, dataloader_idx FROM merged", "dense_preds"))
def _j13(spark, d):
    return p.merge_directions(p.average_duplicates(a.dense_preds(spark, d)))


@plan("f36_sanitise", sql(f"+{MERGED} SELECT sequence_id, src, dst, {P}, y, dataloader_idx FROM merged", "dense_preds"))
def _f36(spark, d):
    return p.sanitise(a.dense_preds(spark, d))


@plan("f22_sigmoid", sql("SELECT sequence_id, src, dst, y, dataloader_idx, " + ", ".join(r(f"1 / (1 + exp(-p{k}))", f"p{k}") for k in range(3)) + " FROM preds", "preds"))
def _f22(spark, d):
    return p.with_sigmoid(a.preds(spark, d))


@plan("f23_softmax", sql(f"+{SOFT} SELECT sequence_id, src, dst, y, dataloader_idx, " + ", ".join(r(f"s{k}", f"p{k}") for k in range(3)) + " FROM soft", "preds"))
def _f23(spark, d):
    return _soft(spark, d)


@plan("f24_binary_expansion", sql(f"SELECT sequence_id, src, dst, {r('1 - a', 'p0')}, 0.0 AS p1, {r('a', 'p2')} FROM (SELECT *, CASE WHEN min(p1) OVER w >= 0 AND max(p1) OVER w <= 1 THEN p1 ELSE 1 / (1 + exp(-p1)) END AS a FROM preds WINDOW w AS (PARTITION BY sequence_id))", "preds"))
def _f24(spark, d):
    return p.expand_binary(a.preds(spark, d).select("sequence_id", "src", "dst", F.col("p1").alias("p0")))


@plan("f25_drop_nan", sql(f"SELECT sequence_id, src, dst, {P} FROM preds WHERE p1 <> 0", "preds"))
def _f25(spark, d):
    made = a.preds(spark, d).withColumn("p0", F.when(F.abs("p1") > 0, F.col("p0")).otherwise(F.lit(float("nan"))))
    return p.drop_nan(made).select("sequence_id", "src", "dst", "p0", "p1", "p2")


for _kind, _own, _thr in (("correspondence", "s1", 0.4), ("division", "s2", 0.3)):
    for _ignore in (True, False):
        _rivals = "greatest(s1, s2)" if _ignore else "greatest(s0, s1, s2)"

        @plan(f"f26_candidates_{_kind}{'' if _ignore else '_all'}", sql(f"+{SOFT} SELECT sequence_id, src, dst, {r('s1', 'p1')}, {r('s2', 'p2')} FROM soft WHERE {_own} > {_thr} AND {_own} = {_rivals}", "preds"))
        def _f26(spark, d, kind=_kind, thr=_thr, ignore=_ignore):
            return p.candidates(_soft(spark, d), kind, thr, ignore).select("sequence_id", "src", "dst", "p1", "p2")


@plan("f27_argmax_class", sql("SELECT sequence_id, src, dst, CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS class, count(*) AS n FROM preds GROUP BY ALL", "preds"))
def _f27(spark, d):
    df = a.preds(spark, d)
    return df.groupBy("sequence_id", "src", "dst", p.argmax_class(df).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@plan("f28_true_class_probability", sql(f"+{SOFT} SELECT sequence_id, src, dst, y, {r('[s0, s1, s2][y + 1]', 'p_true')}, CAST(CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS INTEGER) AS y_pred FROM soft", "preds"))
def _f28(spark, d):
    return p.with_true_class(a.preds(spark, d)).select("sequence_id", "src", "dst", "y", "p_true", "y_pred")


@plan("f34_score_column", sql("SELECT sequence_id, CASE WHEN max(p1) = 0 THEN 'p2' ELSE 'p1' END AS score_column FROM preds GROUP BY sequence_id", "preds"))
def _f34(spark, d):
    return p.specific_score(a.preds(spark, d))


@plan("f35_prediction_frame", sql("SELECT sequence_id, index, " + ", ".join(r(f"embedding[{k + 1}]::DOUBLE", f"p{k}") for k in range(3)) + " FROM vectors", "vectors"))
def _f35(spark, d):
    return p.from_arrays(a.vectors(spark, d), ["index"], "embedding", 3)


@plan("f38_logit_class", sql("SELECT sequence_id, src, dst, CAST(p1 > 0 AS INTEGER) AS class FROM preds", "preds"))
def _f38(spark, d):
    df = a.preds(spark, d).select("sequence_id", "src", "dst", F.col("p1").alias("p0"))
    return df.select("sequence_id", "src", "dst", p.argmax_class(df).alias("class"))


@plan("j12_add_frames", sql("SELECT n.sequence_id, n.index AS src, m.index AS dst, n.t, m.t - n.t AS td FROM nodes n JOIN nodes m ON m.sequence_id = n.sequence_id AND m.label = n.label AND m.index > n.index AND m.index - n.index < 500", "nodes"))
def _j12(spark, d):
    n = a.nodes(spark, d)
    pairs = near_pairs(n, "label", 499)
    return p.add_frames(pairs.select("sequence_id", "src", "dst"), n)


@plan("j20_predictions_with_labels", sql(f"+{AVERAGED.format('dense_preds')} SELECT a.sequence_id, a.src, a.dst, {r('a.p1', 'p1')}, b.y AS label FROM averaged a LEFT JOIN (SELECT * FROM averaged WHERE y = 1) b ON b.sequence_id = a.sequence_id AND b.src = a.src AND b.dst = a.dst", "dense_preds"))
def _j20(spark, d):
    df = p.average_duplicates(a.dense_preds(spark, d))
    return p.with_labels(df.select("sequence_id", "src", "dst", "p1"), df.where("y = 1").select("sequence_id", "src", "dst", F.col("y").alias("label")))


LOSSES = f"{SOFT}, losses AS (SELECT sequence_id, src, dst, y, -ln(greatest([s0, s1, s2][y + 1], 1e-12)) AS loss, [s0, s1, s2][y + 1] AS p_true FROM soft)"


def _losses(spark, d):
    return p.with_true_class(a.preds(spark, d)).withColumn("loss", m.cross_entropy(F.col("p_true")))


@plan("n13_per_sample_loss", sql(f"+{LOSSES} SELECT sequence_id, src, dst, y, {r('loss', 'loss')} FROM losses", "preds"))
def _n13(spark, d):
    return _losses(spark, d).select("sequence_id", "src", "dst", "y", "loss")


@plan("n12_focal_loss", sql(f"+{LOSSES}, f AS (SELECT *, pow(1 - p_true, 2.0) * loss AS focal FROM losses) SELECT sequence_id, {r('avg(focal)', 'mean')}, {r('sum(focal)', 'sum')}, {r('sum(focal) / greatest(count(*) FILTER (WHERE y > 0), 1)', 'weighted_mean')} FROM f GROUP BY sequence_id", "preds"))
def _n12(spark, d):
    df = _losses(spark, d).withColumn("focal", m.focal(F.col("p_true"), 2.0))
    return m.reduce_loss(df, "focal", F.col("y") > 0, ["sequence_id"])


@plan("l3_extreme_samples", sql(f"""+rounded AS (SELECT sequence_id, src, dst, y, max(round(p1, 6)) AS loss FROM dense_preds GROUP BY ALL), a AS (SELECT * FROM rounded QUALIFY row_number() OVER (PARTITION BY sequence_id, y, least(src, dst), greatest(src, dst) ORDER BY loss DESC, src, dst) = 1),
  b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY sequence_id, y, src ORDER BY loss DESC, src, dst) = 1)
  SELECT sequence_id, src, dst, y, {r('loss', 'loss')} FROM b QUALIFY row_number() OVER (PARTITION BY sequence_id, y ORDER BY loss DESC, src, dst) <= 5 OR row_number() OVER (PARTITION BY sequence_id, y ORDER BY loss, src DESC, dst DESC) <= 3""", "dense_preds"))
def _l3(spark, d):
    df = a.dense_preds(spark, d).groupBy("sequence_id", "src", "dst", "y").agg(F.max(F.round("p1", 6)).alias("loss"))
    return p.extreme_samples(df, 5, 3)


@plan("n15_epoch_aggregation", sql(f"SELECT sequence_id, src, dst, {r('avg(p0)', 'p0')}, {r('avg(p1)', 'p1')}, {r('avg(p2)', 'p2')}, min(y) AS y, min(dataloader_idx) AS dataloader_idx FROM (SELECT * FROM preds UNION ALL SELECT * FROM dense_preds) GROUP BY sequence_id, src, dst", "preds", "dense_preds"))
def _n15(spark, d):
    return p.average_duplicates(a.preds(spark, d).unionByName(a.dense_preds(spark, d)))


@plan("n16_misclassified", sql(f"+{SOFT} SELECT sequence_id, src, dst, y, CAST(CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS INTEGER) AS y_pred, {r('[s0, s1, s2][y + 1]', 'p_true')} FROM soft WHERE y <> CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END", "preds"))
def _n16(spark, d):
    return p.with_true_class(a.preds(spark, d)).where("y != y_pred").select("sequence_id", "src", "dst", "y", "y_pred", "p_true")


LABELS = "labels"


@plan("a8_class_counts", "SELECT CAST(c.range AS INTEGER) AS class, count(l.doc_id) AS n FROM range(3) c LEFT JOIN labels l ON coalesce(l.quality, 0) = c.range GROUP BY ALL")
def _a8(spark, d):
    return m.class_counts(a.table(spark, d, "labels"), "quality", 3)


@plan("a9_one_vs_rest", "SELECT CAST(c.range AS INTEGER) AS class, count(*) FILTER (WHERE quality = c.range AND toxic = c.range) AS tp, count(*) FILTER (WHERE quality <> c.range AND toxic = c.range) AS fp, count(*) FILTER (WHERE quality = c.range AND toxic <> c.range) AS fn, count(*) FILTER (WHERE quality <> c.range AND toxic <> c.range) AS tn FROM range(2) c, labels GROUP BY ALL")
def _a9(spark, d):
    return m.one_vs_rest(a.table(spark, d, "labels"), "quality", "toxic", 2)


CONFUSED = "pairs AS (SELECT dataloader_idx, y, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS y_pred FROM preds)"


def _confused(spark, d):
    df = a.preds(spark, d)
    return df.select("dataloader_idx", "y", p.argmax_class(df).alias("y_pred"))


@plan("a10_confusion_matrix", sql(f"+{CONFUSED} SELECT y, CAST(y_pred AS INTEGER) AS y_pred, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY y)', 'row_share')}, {r('count(*) / sum(count(*)) OVER (PARTITION BY y_pred)', 'column_share')} FROM pairs GROUP BY y, y_pred", "preds"))
def _a10(spark, d):
    return m.confusion(_confused(spark, d), "y", "y_pred")


COUNTS = "counts AS (SELECT dataloader_idx, c.range AS class, count(*) FILTER (WHERE y = c.range AND y_pred = c.range) AS tp, count(*) FILTER (WHERE y <> c.range AND y_pred = c.range) AS fp, count(*) FILTER (WHERE y = c.range AND y_pred <> c.range) AS fn, count(*) FILTER (WHERE y <> c.range AND y_pred <> c.range) AS tn FROM pairs, range(3) c GROUP BY ALL)"


@plan("a10_f1_scores", sql(f"+{CONFUSED}, {COUNTS} SELECT dataloader_idx, {r('avg(2 * tp / (2 * tp + fp + fn))', 'macro_f1')}, {r('2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))', 'micro_f1')} FROM counts GROUP BY dataloader_idx", "preds"))
def _a10b(spark, d):
    return m.f1_scores(m.one_vs_rest(_confused(spark, d), "y", "y_pred", 3, ["dataloader_idx"]), ["dataloader_idx"])


@plan("a11_counts_by_loader", sql(f"+{CONFUSED}, {COUNTS} SELECT dataloader_idx, CAST(class AS INTEGER) AS class, tp, fp, fn, tn FROM counts", "preds"))
def _a11(spark, d):
    return m.one_vs_rest(_confused(spark, d), "y", "y_pred", 3, ["dataloader_idx"])


@plan("a12_feature_means", sql("SELECT sequence_id, " + ", ".join(r(f"avg({c})", f"mean_{c}") for c in ("area", "center_0", "center_1")) + " FROM nodes GROUP BY sequence_id", "nodes"))
def _a12(spark, d):
    return m.feature_means(a.nodes(spark, d), ["area", "center_0", "center_1"], ["sequence_id"])


@plan("k14_feature_json_means", sql("SELECT y, " + ", ".join(r(f"avg({c})", f"mean_{c}") for c in ("dist_spat", "overlap", "iou")) + " FROM edges GROUP BY y", "edges"))
def _k14(spark, d):
    return m.feature_means(a.edges(spark, d), ["dist_spat", "overlap", "iou"], ["y"])


for _method in ("sqrt", "effective"):
    _raw = "1 / (sqrt(n / sum(n) OVER ()) + 1e-6)" if _method == "sqrt" else "(1 - 0.999) / (1 - pow(0.999, n) + 1e-6)"

    @plan(f"a22_class_weights_{_method}", sql(f"+c AS (SELECT k.range AS class, count(e.src) AS n FROM range(4) k LEFT JOIN edges e ON e.y = k.range GROUP BY ALL), w AS (SELECT *, CASE WHEN n > 0 THEN {_raw} ELSE 0 END AS raw FROM c) SELECT CAST(class AS INTEGER) AS class, n, {r('raw * (count(*) FILTER (WHERE n > 0) OVER ()) / sum(raw) OVER ()', 'weight')} FROM w", "edges"))
    def _a22(spark, d, method=_method):
        return m.class_weights(m.class_counts(a.edges(spark, d), "y", 4), method)


@plan("a21_sampling_weights", sql(f"+s AS (SELECT sequence_id, count(*) AS size, count(DISTINCT t) AS length FROM nodes GROUP BY ALL), b AS (SELECT *, greatest(pow(size, 0.5) / sum(pow(size, 0.5)) OVER (), 0.2) AS raised FROM s) SELECT sequence_id, size, length, {r('raised / sum(raised) OVER ()', 'mass')}, {r('raised / sum(raised) OVER () / length', 'weight')} FROM b", "nodes"))
def _a21(spark, d):
    sizes = a.nodes(spark, d).groupBy("sequence_id").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("t").alias("length"))
    return m.sampling_weights(sizes, 0.5, 0.2)


@plan("a26_cache_status", "SELECT o_orderkey AS item, CASE WHEN b IS NULL AND a IS NULL THEN 'absent' WHEN b IS NULL THEN 'created' WHEN a IS NULL THEN 'removed' WHEN b = a THEN 'used' ELSE 'invalidated' END AS status FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS b, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END END AS a FROM orders)")
def _a26(spark, d):
    o = a.table(spark, d, "orders")
    before = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey"))
    after = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(1))
    return m.cache_status(o.select(F.col("o_orderkey").alias("item"), before.alias("before"), after.alias("after"))).select("item", "status")


@plan("a27_dataset_summary", sql("+ph AS (SELECT sequence_id, CASE WHEN sequence_id IN ('click', 'view') THEN 'train' ELSE 'val' END AS phase FROM (SELECT DISTINCT sequence_id FROM nodes)), ns AS (SELECT sequence_id, count(DISTINCT t) AS frames, count(*) AS nodes FROM nodes GROUP BY ALL), es AS (SELECT sequence_id, count(*) AS edges FROM edges GROUP BY ALL) SELECT phase, count(*) AS sequences, CAST(coalesce(sum(frames), 0) AS BIGINT) AS frames, CAST(coalesce(sum(nodes), 0) AS BIGINT) AS nodes, CAST(coalesce(sum(edges), 0) AS BIGINT) AS edges FROM ph LEFT JOIN ns USING (sequence_id) LEFT JOIN es USING (sequence_id) GROUP BY phase", "nodes", "edges"))
def _a27(spark, d):
    n = a.nodes(spark, d)
    phases = n.select("sequence_id").distinct().withColumn("phase", F.when(F.col("sequence_id").isin("click", "view"), "train").otherwise("val"))
    return m.phase_summary(n, a.edges(spark, d), phases)
