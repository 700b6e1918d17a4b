"""Plans over files' tables, pixels, vectors and matching."""

from __future__ import annotations


from pyspark.sql import functions as F

from trackweave.operators import edges as e
from trackweave.operators import matching as mt
from trackweave.operators import pixels as px
from trackweave.operators import predictions as p
from trackweave.operators import vectors as v
from trackweave.operators.lineage import lbep
from trackweave.operators.windows import near_pairs
from trackweave.plans.ddb import r, sql
from trackweave.plans.registry import plan
from trackweave.sources import adapters as a
from trackweave.sources import lineage_files as lf
from trackweave.sources.edge_store import EdgeStore, StoreMeta
from trackweave.storage import shared_folder


def _folder(spark, name):
    """A fresh folder among the shared ones."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@plan("s8_lineage_file", sql("SELECT CAST(label_track AS INTEGER) AS label, min(t) AS b, max(t) AS e, CAST(arg_min(parent_track, t) AS INTEGER) AS parent FROM tracks GROUP BY label_track", "tracks"))
def _s8(spark, d):
    path = _folder(spark, "lineage")
    lf.write_lineage(lbep(a.tracks(spark, d)), path)
    return lf.read_lineage(spark, path)


def _states(spark, d):
    n = a.nodes(spark, d)
    number = F.when(F.col("sequence_id") == "click", "007").when(F.col("sequence_id") == "view", "7").otherwise(F.col("sequence_id"))
    return n.select(F.col("label").cast("int").alias("label"), "t", (F.col("index") % 3 + 1).cast("int").alias("state"), F.col("parent").cast("int").alias("parent"), number.alias("sequence_id"))


@plan("s9_states_filter", sql("SELECT CAST(label AS INTEGER) AS label, t, CAST(index % 3 AS INTEGER) AS state, CAST(parent AS INTEGER) AS parent, CASE sequence_id WHEN 'click' THEN '007' ELSE '7' END AS sequence_id FROM nodes WHERE sequence_id IN ('click', 'view')", "nodes"))
def _s9(spark, d):
    path = _folder(spark, "states")
    _states(spark, d).write.option("header", True).csv(path)
    return lf.read_states(spark, path, 7)


@plan("s10_states_to_lineage", sql("SELECT CAST(label AS INTEGER) AS label, min(t) AS b, max(t) AS e, CAST(min(parent) AS INTEGER) AS parent FROM nodes WHERE sequence_id IN ('click', 'view') GROUP BY label", "nodes"))
def _s10(spark, d):
    return lf.states_to_lineage(lf.one_sequence(_states(spark, d), "7"))


def _splits(spark, d):
    return a.table(spark, d, "orders").select((F.col("o_orderkey") % 3).cast("int").alias("fold"), F.when(F.col("o_orderkey") % 5 == 0, "val").otherwise("train").alias("phase"), F.col("o_custkey").cast("string").alias("sequence_id"))


for _name, _phase in (("s2_sequences_of_fold", None), ("s23_sequences_of_phase", "val")):

    @plan(_name, "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS sequence_id FROM orders WHERE o_orderkey % 3 = 1" + (" AND o_orderkey % 5 = 0" if _phase else ""))
    def _s2(spark, d, phase=_phase):
        return lf.sequences_of(_splits(spark, d), 1, phase)


@plan("s21_combined_datasets", sql("SELECT 0 AS dataset, sequence_id, 'events' AS path, 'ctc' AS format FROM (SELECT DISTINCT sequence_id FROM nodes) UNION ALL SELECT 1, sequence_id, 'lineitem', 'flat' FROM (SELECT DISTINCT sequence_id FROM edges)", "nodes", "edges"))
def _s21(spark, d):
    own = lambda f: f(spark, d).select("sequence_id").distinct()
    return lf.combined((own(a.nodes), "events", "ctc"), (own(a.edges), "lineitem", "flat"))


@plan("s22_dry_run", sql("+i AS (SELECT sequence_id, count(DISTINCT t) AS n FROM nodes WHERE index % 2 = 0 OR sequence_id = 'view' GROUP BY ALL), m AS (SELECT sequence_id, count(DISTINCT t) AS n FROM nodes WHERE sequence_id <> 'error' GROUP BY ALL) SELECT coalesce(i.sequence_id, m.sequence_id) AS sequence_id, coalesce(i.n, 0) AS image_frames, coalesce(m.n, 0) AS mask_frames, coalesce(i.n, 0) = coalesce(m.n, 0) AS agree FROM i FULL JOIN m ON i.sequence_id = m.sequence_id", "nodes"))
def _s22(spark, d):
    n = a.nodes(spark, d)
    return lf.dry_run(n.where("index % 2 = 0 or sequence_id = 'view'"), n.where("sequence_id != 'error'"))


@plan("s14_embedding_gather", sql(f"SELECT t.sequence_id, t.index, {r('e.embedding[1]::DOUBLE', 'x0')}, {r('e.embedding[64]::DOUBLE', 'x63')} FROM tracks t JOIN embeddings e ON e.vec_id = t.index", "tracks"))
def _s14(spark, d):
    emb = a.vectors(spark, d).select("index", "embedding")
    return a.tracks(spark, d).join(emb, "index").select("sequence_id", "index", F.element_at("embedding", 1).cast("double").alias("x0"), F.element_at("embedding", 64).cast("double").alias("x63"))


@plan("k4_embedding_rows", sql(f"SELECT t.sequence_id, t.index, {r('coalesce(e.embedding[1]::DOUBLE, 0)', 'x0')} FROM tracks t LEFT JOIN embeddings e ON e.vec_id = t.index", "tracks"))
def _k4(spark, d):
    emb = a.vectors(spark, d).select("index", "embedding")
    full = a.tracks(spark, d).join(emb, "index", "left").withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64)))
    return full.select("sequence_id", "index", F.element_at("embedding", 1).cast("double").alias("x0"))


@plan("s11_node_cache", sql(f"SELECT sequence_id, count(*) AS n, {r('avg(area)', 'area')} FROM nodes GROUP BY sequence_id", "nodes"))
def _s11(spark, d):
    path = _folder(spark, "nodes")
    a.nodes(spark, d).write.partitionBy("sequence_id").parquet(path)
    return spark.read.parquet(path).groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"), F.avg("area").alias("area"))


STORED = "stored AS (SELECT DISTINCT l_returnflag AS sequence_id, l_orderkey AS src, l_partkey AS dst, CAST(l_suppkey % 3 + 1 AS INTEGER) AS dist_temp, l_quantity AS dist_spat FROM lineitem)"


def _stored(spark, d):
    return a.edges(spark, d).select("sequence_id", "src", "dst", "dist_temp", "dist_spat", (F.col("src") % 48).cast("int").alias("t")).distinct()


def _store(spark, d):
    """A store made for strides 1 and 2 with a wide radius, then asked for all three with a narrow one."""
    store, links = EdgeStore(spark, _folder(spark, "store")), _stored(spark, d)
    compute = lambda strides, radius: links.where(F.col("dist_temp").isin(strides)).where(F.col("dist_spat") <= radius)
    store.get(StoreMeta(45.0, True, strides=[1, 2]), compute)
    return store, store.get(StoreMeta(20.0, True, strides=[1, 2, 3]), compute)


@plan("g3_incremental_store", sql(f"+{STORED} SELECT sequence_id, src, dst, dist_temp, {r('dist_spat', 'dist_spat')} FROM (SELECT * FROM stored WHERE dist_spat <= 20 UNION ALL SELECT sequence_id, dst, src, -dist_temp, dist_spat FROM stored WHERE dist_spat <= 20)", "edges"))
def _g3(spark, d):
    return _store(spark, d)[1].select("sequence_id", "src", "dst", "dist_temp", "dist_spat")


@plan("k2_store_content", sql(f"+{STORED} SELECT dist_temp AS dt, count(*) AS n, {r('max(dist_spat)', 'widest')} FROM stored WHERE dist_spat <= 45 GROUP BY dist_temp", "edges"))
def _k2(spark, d):
    store, _ = _store(spark, d)
    return spark.read.parquet(f"{store.path}/links").groupBy("dt").agg(F.count(F.lit(1)).alias("n"), F.max("dist_spat").alias("widest"))


@plan("k3_store_trim", sql(f"+{STORED} SELECT sequence_id, src, dst, dist_temp FROM stored WHERE dist_temp IN (1, 3) AND dist_spat <= 45", "edges"))
def _k3(spark, d):
    store, _ = _store(spark, d)
    return store.scan([1, 3], 45.0, False).select("sequence_id", "src", "dst", "dist_temp")


for _name in ("s12_stride_scan", "g14_store_load"):

    @plan(_name, sql(f"+{STORED} SELECT sequence_id, src, dst, dist_temp FROM (SELECT * FROM stored WHERE dist_temp = 2 AND dist_spat <= 30 UNION ALL SELECT sequence_id, dst, src, -dist_temp, dist_spat FROM stored WHERE dist_temp = 2 AND dist_spat <= 30)", "edges"))
    def _s12(spark, d):
        store, _ = _store(spark, d)
        return store.scan([2], 30.0, True).select("sequence_id", "src", "dst", "dist_temp")


@plan("s13_available_strides", "SELECT DISTINCT CAST(l_suppkey % 3 + 1 AS INTEGER) AS dt FROM lineitem WHERE l_quantity <= 45")
def _s13(spark, d):
    store, _ = _store(spark, d)
    return spark.read.parquet(f"{store.path}/links").select("dt").distinct()


REGION = f"""SELECT sequence_id, t, label, area, bbox_0, bbox_1, bbox_2, bbox_3, {r('c0', 'centroid_0')}, {r('c1', 'centroid_1')}, round(4 * sqrt((yy + xx) / 2 + rt), 4) + 0.0 AS axis_major_length, {r('intensity_min', 'intensity_min')}, {r('intensity_mean', 'intensity_mean')}, {r('intensity_max', 'intensity_max')}
  FROM (SELECT *, sqrt(pow((yy - xx) / 2, 2) + pow(yx, 2)) AS rt FROM (SELECT sequence_id, t, label, count(*) AS area, min(y) AS bbox_0, min(x) AS bbox_1, max(y) + 1 AS bbox_2, max(x) + 1 AS bbox_3, avg(y) AS c0, avg(x) AS c1, var_pop(y) AS yy, var_pop(x) AS xx, covar_pop(y, x) AS yx, min(intensity) AS intensity_min, avg(intensity) AS intensity_mean, max(intensity) AS intensity_max FROM pixels WHERE label <> 0 GROUP BY ALL))"""


@plan("a2_region_properties", sql(REGION, "pixels"))
def _a2(spark, d):
    df = px.region_properties(a.pixels(spark, d)).withColumn("axis_major_length", F.round("axis_major_length", 4))
    return df.drop("axis_minor_length", "orientation", "eccentricity")


VOLUMES = "v AS (SELECT sequence_id, t, (y * 7 + x * 3) % 11 AS z, y, x, label % 3 AS label, intensity FROM pixels WHERE label % 3 > 0), m AS (SELECT sequence_id, t, label, count(*) AS area, min(z) AS bbox_0, min(y) AS bbox_1, min(x) AS bbox_2, max(z) + 1 AS bbox_3, max(y) + 1 AS bbox_4, max(x) + 1 AS bbox_5, avg(z) AS c0, avg(y) AS c1, avg(x) AS c2, avg(intensity) AS im, var_pop(z) AS a, var_pop(y) AS b, var_pop(x) AS c, covar_pop(z, y) AS d, covar_pop(z, x) AS e, covar_pop(y, x) AS f FROM v GROUP BY ALL), q AS (SELECT *, (a + b + c) / 3 AS q FROM m), p AS (SELECT *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q), g AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p)))) / 3 ELSE 0 END AS angle FROM p)"


@plan("a2_volume_properties", sql(f"+{VOLUMES} SELECT sequence_id, t, label, area, bbox_0, bbox_1, bbox_2, bbox_3, bbox_4, bbox_5, {r('c0', 'centroid_0')}, {r('c1', 'centroid_1')}, {r('c2', 'centroid_2')}, {r('im', 'intensity_mean')}, round(sqrt(20 * greatest(q + 2 * p * cos(angle), 0)), 3) + 0.0 AS axis_major_length FROM g", "pixels"))
def _a2_volume(spark, d):
    p = a.pixels(spark, d).where("label % 3 > 0").withColumns({"z": (F.col("y") * 7 + F.col("x") * 3) % 11, "label": F.col("label") % 3})
    out = px.region_properties_3d(p).withColumn("axis_major_length", F.round("axis_major_length", 3))
    return out.drop("axis_minor_length", "intensity_min", "intensity_max")


@plan("s6_instance_check", sql("+picked AS (SELECT DISTINCT sequence_id, CAST(floor(k.range * m / 15) AS INTEGER) AS t FROM (SELECT sequence_id, max(t) AS m FROM pixels GROUP BY ALL), range(16) k) SELECT p.sequence_id, p.t, count(DISTINCT label) AS labels FROM pixels p JOIN picked USING (sequence_id, t) WHERE label <> 0 GROUP BY ALL", "pixels"))
def _s6(spark, d):
    return px.instance_check(a.pixels(spark, d))


@plan("a4_thickness", sql(f"+own AS (SELECT sequence_id, t, label, y, x FROM pixels WHERE label <> 0), rim AS (SELECT DISTINCT o.sequence_id, o.t, o.label, o.y + dy.range AS ry, o.x + dx.range AS rx FROM own o, range(-1, 2) dy, range(-1, 2) dx WHERE NOT EXISTS (SELECT 1 FROM own q WHERE q.sequence_id = o.sequence_id AND q.t = o.t AND q.label = o.label AND q.y = o.y + dy.range AND q.x = o.x + dx.range)), n AS (SELECT o.sequence_id, o.t, o.label, o.y, o.x, min(sqrt((o.y - ry) * (o.y - ry) + (o.x - rx) * (o.x - rx))) AS d FROM own o JOIN rim r ON r.sequence_id = o.sequence_id AND r.t = o.t AND r.label = o.label GROUP BY ALL) SELECT sequence_id, t, label, {r('2 * max(d)', 'thickness')} FROM n GROUP BY ALL", "pixels"))
def _a4(spark, d):
    return px.thickness(a.pixels(spark, d))


@plan("c14_connected_parts")
def _c14(spark, d):
    p = a.pixels(spark, d).withColumns({"y": F.floor(F.col("y") / 40).cast("int"), "x": F.floor(F.col("x") / 20).cast("int")})
    return px.connected_parts(p.groupBy("sequence_id", "t", "y", "x").agg(F.min(F.col("label") % 3).alias("label")))


@plan("a24_content_identity", sql("SELECT sequence_id, t, sha256(string_agg(y || ',' || x || ',' || label, ';' ORDER BY y, x, label)) AS digest FROM pixels GROUP BY ALL", "pixels"))
def _a24(spark, d):
    return px.content_identity(a.pixels(spark, d))


@plan("n5_weighted_pooling", sql(f"+f AS (SELECT label, pos, sum(w * x) / sum(w) AS x FROM (SELECT label, (index % 5 + 1) AS w, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM vectors) GROUP BY ALL) SELECT CAST(label AS BIGINT) AS index, {r('sum(x)', 'total')}, {r('max(x)', 'largest')} FROM f GROUP BY label", "vectors"))
def _n5(spark, d):
    tokens = a.vectors(spark, d).select("sequence_id", F.col("label").cast("long").alias("index"), (F.col("index") % 5 + 1).alias("weight"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return v.pooled(tokens).select("index", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max("embedding").alias("largest"))


@plan("n7_feature_concat", sql(f"SELECT index, len(list_concat(embedding, embedding)) AS n, {r('list_sum(list_concat(embedding, embedding)::DOUBLE[])', 'total')} FROM vectors", "vectors"))
def _n7(spark, d):
    df = v.concatenated(a.vectors(spark, d), "embedding", "embedding")
    return df.select("index", F.size("features").cast("long").alias("n"), F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"))


MESSAGES = "flat AS (SELECT s.index AS src, d.index AS dst, unnest(range(64)) AS pos, unnest(s.embedding)::DOUBLE AS x FROM vectors s JOIN vectors d ON s.label = d.label AND abs(s.index - d.index) BETWEEN 1 AND 20)"


def _message_edges(spark, d):
    vec = a.vectors(spark, d)
    one = near_pairs(vec, "label", 20)
    both = one.select("sequence_id", "src", "dst").union(one.select("sequence_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.join(vec.select("sequence_id", F.col("index").alias("src"), F.transform("embedding", lambda x: x.cast("double")).alias("message")), ["sequence_id", "src"]).select("sequence_id", "src", "dst", "message")


for _how in ("mean", "max", "min"):

    @plan(f"n9_messages_{_how}", sql(f"+{MESSAGES}, g AS (SELECT dst AS index, pos, {'avg' if _how == 'mean' else _how}(x) AS x FROM flat GROUP BY ALL) SELECT v.index, {r('coalesce(sum(g.x), 0)', 'total')}, {r('coalesce(max(g.x), 0)', 'largest')} FROM vectors v LEFT JOIN g ON g.index = v.index GROUP BY v.index", "vectors"))
    def _n9(spark, d, how=_how):
        df = v.messages(_message_edges(spark, d), a.vectors(spark, d), how)
        return df.select("index", F.aggregate("message", F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max("message").alias("largest"))


@plan("n10_time_aware_messages", sql(f"+{MESSAGES}, g AS (SELECT dst AS index, src < dst AS past, pos, avg(x) AS x FROM flat GROUP BY ALL) SELECT v.index, {r('coalesce((SELECT sum(x) FROM g WHERE g.index = v.index AND past), 0)', 'past')}, {r('coalesce((SELECT sum(x) FROM g WHERE g.index = v.index AND NOT past), 0)', 'future')}, {r('list_sum(v.embedding::DOUBLE[])', 'own')} FROM vectors v", "vectors"))
def _n10(spark, d):
    df = v.time_aware_messages(_message_edges(spark, d), a.vectors(spark, d))
    part = lambda k: F.aggregate(F.slice("features", 64 * k + 1, 64), F.lit(0.0), lambda s, x: s + x)
    return df.select("index", part(0).alias("past"), part(1).alias("future"), part(2).alias("own"))


@plan("n8_edge_inputs", sql(f"SELECT s.index AS src, d.index AS dst, {r('list_sum(s.embedding::DOUBLE[]) * 2 + list_sum(d.embedding::DOUBLE[])', 'total')} FROM vectors s JOIN vectors d ON s.label = d.label AND abs(s.index - d.index) BETWEEN 1 AND 20", "vectors"))
def _n8(spark, d):
    df = v.edge_inputs(_message_edges(spark, d), a.vectors(spark, d))
    return df.select("src", "dst", F.aggregate("features", F.lit(0.0), lambda s, x: s + x).alias("total"))


@plan("n11_message_network")
def _n11(spark, d):
    layer = ([[((i * 7 + j * 3) % 11 - 5) / 50 for j in range(192)] for i in range(64)], [0.01 * i for i in range(64)])
    df = v.network(a.vectors(spark, d), _message_edges(spark, d), [layer])
    return df.select("index", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("total"))


def _candidates(spark, d):
    n = a.nodes(spark, d)
    near = e.radius_join(n, [1, 2], 20.0, ["center_0", "center_1"])
    near = near.withColumns({"p1": F.exp(-F.col("dist_spat") / 10), "p2": F.exp(-F.col("dist_spat") / 12) * 0.9, "p0": F.lit(0.0)})
    corr = p.candidates(near, "correspondence", 0.3).withColumn("kind", F.lit("correspondence"))
    div = p.candidates(near, "division", 0.2).withColumn("kind", F.lit("division"))
    return corr.unionByName(div)


@plan("g6_frame_matching")
def _g6(spark, d):
    return mt.link(_candidates(spark, d))


@plan("g8_single_daughter_rescue")
def _g8(spark, d):
    return mt.link(_candidates(spark, d), rescue=True)


@plan("g9_tracker")
def _g9(spark, d):
    from trackweave.operators.lineage import numbered_labels, trajectories

    n = a.nodes(spark, d)
    return numbered_labels(trajectories(n, mt.link(_candidates(spark, d)).select("sequence_id", "src", "dst")))
