"""Plans over trajectories, their lineage, checks and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.operators import correction as c
from trackweave.operators import lineage as ln
from trackweave.operators import markers
from trackweave.operators.numbering import numbered
from trackweave.plans.ddb import r, sql
from trackweave.plans.registry import plan
from trackweave.sources import adapters as a

SPAN = "span AS (SELECT sequence_id, label_track, min(t) AS b, max(t) AS e, count(DISTINCT t) AS n, max(parent_track) AS parent FROM tracks GROUP BY ALL)"
NEXT = "nexts AS (SELECT *, lead(index) OVER w AS next_index, lead(t) OVER w AS next_t, lead(center_0) OVER w AS next_center_0, lead(center_1) OVER w AS next_center_1, lag(t) OVER w AS prev_t FROM tracks WINDOW w AS (PARTITION BY sequence_id, label_track ORDER BY t, index)), gaps AS (SELECT *, next_t - t AS t_diff FROM nexts WHERE next_t - t > 1)"


@plan("a5_lbep", sql("SELECT sequence_id, label_track AS label, min(t) AS b, max(t) AS e, arg_min(parent_track, t) AS parent FROM tracks GROUP BY ALL", "tracks"))
def _a5(spark, d):
    return ln.lbep(a.tracks(spark, d))


@plan("flagship_lbep_with_gaps", sql(f"+{NEXT}, g AS (SELECT sequence_id, label_track, count(*) AS gaps, sum(t_diff - 1) AS missing FROM gaps GROUP BY ALL) SELECT t.sequence_id, t.label_track AS label, min(t) AS b, max(t) AS e, arg_min(parent_track, t) AS parent, coalesce(max(g.gaps), 0) AS gaps, CAST(coalesce(max(g.missing), 0) AS BIGINT) AS missing FROM tracks t LEFT JOIN g ON g.label_track = t.label_track GROUP BY ALL", "tracks"))
def _flagship(spark, d):
    t = a.tracks(spark, d)
    g = c.gaps(t).groupBy("sequence_id", F.col("label_track").alias("label")).agg(F.count(F.lit(1)).alias("gaps"), F.sum("t_diff").alias("_s"))
    out = ln.lbep(t).join(g, ["sequence_id", "label"], "left")
    return out.select("sequence_id", "label", "b", "e", "parent", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce(F.col("_s") - F.col("gaps"), F.lit(0)).alias("missing"))


@plan("w2_gaps", sql(f"+{NEXT} SELECT sequence_id, label_track, index, t, next_index, next_t, t_diff FROM gaps", "tracks"))
def _w2(spark, d):
    return c.gaps(a.tracks(spark, d)).select("sequence_id", "label_track", "index", "t", "next_index", "next_t", "t_diff")


@plan("f33_interpolation", sql(f"+{NEXT} SELECT sequence_id, label_track, t, index, {r('center_0', 'center_0')}, {r('center_1', 'center_1')}, parent_track, cell_source FROM tracks UNION ALL SELECT sequence_id, label_track, CAST(t + s.step AS INTEGER), (SELECT max(index) FROM tracks) + row_number() OVER (ORDER BY label_track, t + s.step), {r('center_0 + (next_center_0 - center_0) * s.step / t_diff', 'center_0')}, {r('center_1 + (next_center_1 - center_1) * s.step / t_diff', 'center_1')}, parent_track, 'interpolated' FROM gaps, unnest(range(1, t_diff)) s(step)", "tracks"))
def _f33(spark, d):
    """The trajectories with the positions in all missing frames, however wide the gap."""
    return c.fill_gaps(a.tracks(spark, d)).select("sequence_id", "label_track", "t", "index", "center_0", "center_1", "parent_track", "cell_source")


for _name in ("c2_fill_gaps", "c16_row_placement"):

    @plan(_name, sql(f"+{NEXT} SELECT sequence_id, label_track, t, index, {r('center_0', 'center_0')}, {r('center_1', 'center_1')}, parent_track, cell_source FROM tracks UNION ALL SELECT sequence_id, label_track, CAST(t + s.range AS INTEGER), (SELECT max(index) FROM tracks) + row_number() OVER (ORDER BY label_track, t + s.range), {r('center_0 + (next_center_0 - center_0) * s.range / t_diff', 'center_0')}, {r('center_1 + (next_center_1 - center_1) * s.range / t_diff', 'center_1')}, parent_track, 'interpolated' FROM gaps, range(1, 400) s WHERE s.range < t_diff AND t_diff <= 4", "tracks"))
    def _c2(spark, d):
        return c.fill_gaps(a.tracks(spark, d), 3).select("sequence_id", "label_track", "t", "index", "center_0", "center_1", "parent_track", "cell_source")


DIVIDED = "ends AS (SELECT sequence_id, label_track AS parent, max(t) AS parent_last FROM tracks GROUP BY ALL), starts AS (SELECT sequence_id, parent_track AS parent, min(t) AS first FROM tracks WHERE parent_track > 0 GROUP BY ALL), late AS (SELECT e.*, s.first FROM ends e JOIN starts s ON s.sequence_id = e.sequence_id AND s.parent = e.parent WHERE s.first - e.parent_last > 1)"


@plan("j22_division_gaps", sql("+ends AS (SELECT sequence_id, label_track AS parent, max(t) AS parent_last FROM tracks GROUP BY ALL), born AS (SELECT sequence_id, label_track, parent_track AS parent, min(t) AS first FROM tracks WHERE parent_track > 0 GROUP BY ALL) SELECT b.sequence_id, b.label_track, b.parent, e.parent_last, b.first, min(b.first) OVER (PARTITION BY b.sequence_id, b.parent) AS parent_first FROM born b JOIN ends e ON e.sequence_id = b.sequence_id AND e.parent = b.parent QUALIFY b.first - e.parent_last > 1", "early"))
def _j22(spark, d):
    """Every daughter that begins late, with when the parent's first one does."""
    return c.late_daughters(_early(spark, d))


def _early(spark, d):
    """tracks whose lower labels end early, so that divisions leave gaps."""
    return a.tracks(spark, d).where("t < 12 or label_track >= 40").where("t >= 15 or label_track < 40")


@plan("c3_fill_division_gaps", sql(f"+{DIVIDED}, m AS (SELECT g.parent, g.parent_last, g.first, avg(t.center_0) AS to_0, avg(t.center_1) AS to_1 FROM late g JOIN tracks t ON t.parent_track = g.parent AND t.t = g.first GROUP BY ALL) SELECT p.sequence_id, p.label_track, CAST(k.range AS INTEGER) AS t, {r('p.center_0 + (to_0 - p.center_0) * (k.range - parent_last) / (first - parent_last)', 'center_0')}, {r('p.center_1 + (to_1 - p.center_1) * (k.range - parent_last) / (first - parent_last)', 'center_1')} FROM m JOIN tracks p ON p.label_track = m.parent AND p.t = m.parent_last, range(0, 400) k WHERE k.range > parent_last AND k.range < first", "early"))
def _c3(spark, d):
    return c.fill_division_gaps(_early(spark, d))


PIECES = f"{NEXT}, cut AS (SELECT *, sum(CASE WHEN t - prev_t > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sequence_id, label_track ORDER BY t, index) AS piece FROM nexts), pieces AS (SELECT label_track, piece, min(t) AS b, max(t) AS e FROM cut GROUP BY ALL), named AS (SELECT *, CASE WHEN piece = 0 THEN label_track ELSE (SELECT max(label_track) FROM tracks) + row_number() OVER (PARTITION BY piece > 0 ORDER BY label_track, b) END AS name FROM pieces), born AS (SELECT label_track, min(t) AS birth, max(parent_track) AS parent FROM tracks GROUP BY ALL), follow AS (SELECT b.label_track, min(n.name) AS alive FROM born b JOIN named n ON n.label_track = b.parent AND b.birth - 1 BETWEEN n.b AND n.e GROUP BY ALL)"

for _name in ("c11_split_at_gaps", "w8_pieces"):

    @plan(_name, sql(f"+{PIECES} SELECT t.sequence_id, t.index, t.t, n.name AS label_track, CASE WHEN t.piece > 0 THEN 0 ELSE coalesce(f.alive, t.parent_track) END AS parent_track FROM cut t JOIN named n ON n.label_track = t.label_track AND n.piece = t.piece LEFT JOIN follow f ON f.label_track = t.label_track", "tracks"))
    def _c11(spark, d):
        return c.split_at_gaps(a.tracks(spark, d)).select("sequence_id", "index", "t", "label_track", "parent_track")


def _there(spark, d):
    """Pixels for two thirds of the tracks' rows."""
    return a.tracks(spark, d).where("index % 3 > 0 and label_track % 11 > 0").select("sequence_id", "t", F.col("label_track").alias("label"), F.lit(1).alias("y"), F.lit(1).alias("x"))


KEPT = "kept AS (SELECT * FROM tracks WHERE index % 3 > 0 AND label_track % 11 > 0 AND label_track <> 0)"


@plan("c10_drop_orphans", sql(f"+{KEPT} SELECT sequence_id, index, t, label_track, CASE WHEN parent_track IN (SELECT label_track FROM kept) THEN parent_track ELSE 0 END AS parent_track FROM kept", "tracks"))
def _c10(spark, d):
    return c.drop_orphans(a.tracks(spark, d), _there(spark, d)).select("sequence_id", "index", "t", "label_track", "parent_track")


@plan("a16_mask_label_map", sql(f"+{KEPT} SELECT DISTINCT sequence_id, t, label_track AS label FROM kept", "tracks"))
def _a16(spark, d):
    return _there(spark, d).where("label != 0").select("sequence_id", "t", "label").distinct()


@plan("j18_remove_rows", sql("+left_rows AS (SELECT * FROM tracks WHERE index % 5 > 0 AND label_track % 7 > 0) SELECT sequence_id, index, t, label_track, CASE WHEN parent_track IN (SELECT label_track FROM left_rows) THEN parent_track ELSE 0 END AS parent_track FROM left_rows", "tracks"))
def _j18(spark, d):
    t = a.tracks(spark, d)
    return c.remove_rows(t, t.where("index % 5 = 0 or label_track % 7 = 0"), True).select("sequence_id", "index", "t", "label_track", "parent_track")


for _name in ("c8_relabel_map", "c17_relabel_labels"):

    @plan(_name, sql("SELECT sequence_id, index, CASE WHEN label_track % 10 = 3 THEN label_track + 1000 ELSE label_track END AS label_track, CASE WHEN parent_track % 10 = 3 THEN parent_track + 1000 ELSE parent_track END AS parent_track FROM tracks", "tracks"))
    def _c8(spark, d):
        t = a.tracks(spark, d)
        every = t.select("sequence_id", F.explode(F.array("label_track", "parent_track")).alias("old")).distinct().where("old % 10 = 3").withColumn("new", F.col("old") + 1000)
        return c.relabel(t, every).select("sequence_id", "index", "label_track", "parent_track")


@plan("c9_relabel_track", sql("+x AS (SELECT *, min(t) OVER (PARTITION BY label_track) AS born FROM early) SELECT sequence_id, index, CASE WHEN label_track = 30 AND t >= 5 THEN 900 ELSE label_track END AS label_track, CASE WHEN parent_track = 30 AND born > 5 THEN 900 ELSE parent_track END AS parent_track FROM x", "early"))
def _c9(spark, d):
    return c.relabel_from(_early(spark, d), 30, 900, 5).select("sequence_id", "index", "label_track", "parent_track")


@plan("a13_short_tracks", sql("+l AS (SELECT *, max(t) OVER w - min(t) OVER w + 1 AS lifetime FROM early WINDOW w AS (PARTITION BY sequence_id, label_track)), last AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY sequence_id, label_track ORDER BY t DESC, index DESC) = 1) SELECT sequence_id, label_track, t, lifetime FROM last WHERE lifetime <= 13 AND t + lifetime <= (SELECT max(t) FROM last)", "early"))
def _a13(spark, d):
    return c.short_tracks(_early(spark, d), 13).select("sequence_id", "label_track", "t", "lifetime")


@plan("w3_lifetime", sql("SELECT sequence_id, index, max(t) OVER w - min(t) OVER w + 1 AS lifetime FROM tracks WINDOW w AS (PARTITION BY sequence_id, label_track)", "tracks"))
def _w3(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("sequence_id", "label_track")
    return a.tracks(spark, d).select("sequence_id", "index", (F.max("t").over(w) - F.min("t").over(w) + 1).alias("lifetime"))


@plan("a14_trajectory_spans", sql("SELECT sequence_id, label_track, min(t) AS first, max(t) AS last, count(DISTINCT t) AS frames, count(DISTINCT index) AS nodes, max(parent_track) AS parent FROM tracks GROUP BY ALL", "tracks"))
def _a14(spark, d):
    return ln.spans(a.tracks(spark, d)).withColumns({"frames": F.size("frames").cast("long"), "nodes": F.size("nodes").cast("long")})


@plan("a15_division_statistics", sql(f"+{SPAN} SELECT sequence_id, parent, count(DISTINCT label_track) AS daughters, min(b) AS first, count(DISTINCT b) AS starts FROM span WHERE parent > 0 AND parent <> label_track GROUP BY ALL", "tracks"))
def _a15(spark, d):
    return c.division_statistics(a.tracks(spark, d))


@plan("j21_parent_overlap", sql(f"+{SPAN} SELECT t.sequence_id, t.label_track, s.label_track AS daughter, t.t FROM tracks t JOIN span s ON s.parent = t.label_track WHERE s.parent > 0 AND s.parent <> s.label_track AND t.t >= s.b", "tracks"))
def _j21(spark, d):
    return c.overlaps_parent(a.tracks(spark, d))


def _brief(spark, d):
    """tracks with brief trajectories: a label for each two days of a user, beside users that last."""
    t = a.tracks(spark, d)
    brief = F.when(F.col("label_track") % 4 == 0, F.col("label_track") * 1000 + F.floor(F.col("t") / 2)).otherwise(F.col("label_track"))
    return t.withColumns({"label_track": brief, "parent_track": F.when(F.col("label_track") % 8 == 1, F.col("parent_track")).otherwise(0)})


COVER = f"{NEXT}, {SPAN}, cover AS (SELECT DISTINCT s.sequence_id, s.label_track AS inner_track, g.label_track AS outer_track FROM span s JOIN gaps g ON s.b > g.t AND s.e < g.next_t AND s.label_track <> g.label_track)"


@plan("j23_covering_cells", sql(f"+{COVER} SELECT sequence_id, inner_track AS inner, outer_track AS outer FROM cover", "brief"))
def _j23(spark, d):
    return c.covering(_brief(spark, d))


@plan("j24_gap_only", sql(f"+{COVER} SELECT DISTINCT sequence_id, inner_track AS label_track FROM cover", "brief"))
def _j24(spark, d):
    return c.gap_only(_brief(spark, d))


def _links_of(spark, d):
    """Scores between the rows of neighbouring labels in the next frame."""
    t = a.tracks(spark, d).select("sequence_id", "t", "label_track", "index")
    nxt = t.select("sequence_id", (F.col("t") - 1).alias("t"), (F.col("label_track") - 1).alias("label_track"), F.col("index").alias("dst"))
    score = lambda k: (F.col("src") * k + F.col("dst") * 7) % 100 / 100
    return t.withColumnRenamed("index", "src").join(nxt, ["sequence_id", "t", "label_track"]).select("sequence_id", "src", "dst", score(3).alias("p1"), score(5).alias("p2"))


LINKED = "preds AS (SELECT t.sequence_id, t.index AS src, n.index AS dst, (t.index * 3 + n.index * 7) % 100 / 100 AS p1, (t.index * 5 + n.index * 7) % 100 / 100 AS p2 FROM base n JOIN base t ON n.t - 1 = t.t AND n.label_track - 1 = t.label_track)"


def _bridges(spark, d):
    """Scores from each row of a trajectory to its next one, and to the row that is next by index."""
    from pyspark.sql import Window

    t = _brief(spark, d)
    nxt = F.lead("index").over(Window.partitionBy("sequence_id", "label_track").orderBy("t", "index"))
    own = t.select("sequence_id", F.col("index").alias("src"), nxt.alias("dst")).where("dst is not null").withColumn("p1", (F.col("src") * 3 + F.col("dst") * 7) % 10 / 10 + 0.4)
    return own.union(t.select("sequence_id", F.col("index").alias("src"), (F.col("index") + 1).alias("dst"), (F.col("index") * 3 % 100 / 100).alias("p1"))).withColumn("p2", F.lit(0.0))


BRIDGED = "bridged AS (SELECT index, lead(index) OVER (PARTITION BY label_track ORDER BY t, index) AS nxt FROM tracks), preds AS (SELECT index AS src, nxt AS dst, (index * 3 + nxt * 7) % 10 / 10 + 0.4 AS p1 FROM bridged WHERE nxt IS NOT NULL UNION ALL SELECT index, index + 1, index * 3 % 100 / 100 FROM tracks)"


@plan("c6_removable_merges", sql(f"+{BRIDGED}, {COVER}, free AS (SELECT DISTINCT inner_track AS l FROM cover WHERE inner_track NOT IN (SELECT label_track FROM tracks WHERE parent_track > 0 AND parent_track <> label_track) AND inner_track NOT IN (SELECT parent_track FROM tracks WHERE parent_track > 0 AND parent_track <> label_track)), own AS (SELECT t.* FROM tracks t JOIN free ON l = t.label_track), leaving AS (SELECT DISTINCT o.label_track AS l FROM own o JOIN preds p ON p.src = o.index WHERE p.p1 > 0.5 AND NOT EXISTS (SELECT 1 FROM own z WHERE z.label_track = o.label_track AND z.index = p.dst)), left_over AS (SELECT l FROM free WHERE l NOT IN (SELECT l FROM leaving)), rim AS (SELECT i.label_track AS ins, o.label_track AS outs, i.b, i.e FROM span i JOIN left_over f ON f.l = i.label_track JOIN span o ON o.b < i.b AND o.e > i.e AND NOT EXISTS (SELECT 1 FROM tracks x JOIN tracks y ON y.t = x.t AND y.label_track = i.label_track WHERE x.label_track = o.label_track)), ends AS (SELECT ins, outs, arg_max(t.index, t.t) FILTER (WHERE t.t < rim.b) AS before, arg_min(t.index, t.t) FILTER (WHERE t.t > rim.e) AS after FROM rim JOIN tracks t ON t.label_track = rim.outs GROUP BY ALL), linked AS (SELECT DISTINCT e.ins, e.before FROM ends e JOIN preds p ON p.src = e.before AND p.p1 > 0.5 JOIN ends z ON z.ins = e.ins AND z.after = p.dst) SELECT 'events' AS sequence_id, e.ins AS label_track FROM ends e LEFT JOIN linked l ON l.ins = e.ins AND l.before = e.before GROUP BY e.ins HAVING count(*) = count(l.before)", "brief"))
def _c6(spark, d):
    return c.removable_merges(_brief(spark, d), _bridges(spark, d), 0.5)


@plan("a19_best_correspondence", sql(f"+{LINKED} SELECT sequence_id, dst AS index, {r('max(p1)', 'best')} FROM preds GROUP BY ALL", "base"))
def _a19(spark, d):
    return c.best_score(_links_of(spark, d), "dst")


@plan("a20_strong_external_edge", sql(f"+{LINKED}, m AS (SELECT t AS g, index FROM base WHERE label_track < 60) SELECT DISTINCT p.sequence_id, m.g AS group FROM preds p JOIN m ON m.index = p.src OR m.index = p.dst WHERE greatest(p1, p2) > 0.9 AND NOT (EXISTS (SELECT 1 FROM m k WHERE k.g = m.g AND k.index = p.src) AND EXISTS (SELECT 1 FROM m k WHERE k.g = m.g AND k.index = p.dst))", "base"))
def _a20(spark, d):
    members = a.tracks(spark, d).where("label_track < 60").select("sequence_id", F.col("t").alias("group"), "index")
    return c.strong_external(_links_of(spark, d), members, 0.9)


@plan("l4_top_targets", sql(f"SELECT sequence_id, src, dst, {r('p2', 'p2')}, CAST(row_number() OVER (PARTITION BY sequence_id, src ORDER BY p2 DESC, dst) AS INTEGER) AS rank FROM (SELECT sequence_id, src, dst, max(round(p2, 6)) AS p2 FROM dense_preds GROUP BY ALL) QUALIFY rank <= 2", "dense_preds"))
def _l4(spark, d):
    df = a.dense_preds(spark, d).groupBy("sequence_id", "src", "dst").agg(F.max(F.round("p2", 6)).alias("p2"))
    return c.top_targets(df)


@plan("w4_targets_per_source", sql("SELECT sequence_id, src, dst, y, count(*) OVER (PARTITION BY sequence_id, src) AS n FROM preds", "preds"))
def _w4(spark, d):
    from pyspark.sql import Window

    return a.preds(spark, d).select("sequence_id", "src", "dst", "y", F.count(F.lit(1)).over(Window.partitionBy("sequence_id", "src")).alias("n"))


@plan("w5_first_and_last", sql("SELECT sequence_id, label_track, arg_min(index, t) AS first, arg_max(index, t) AS last FROM tracks GROUP BY ALL", "tracks"))
def _w5(spark, d):
    return a.tracks(spark, d).groupBy("sequence_id", "label_track").agg(F.min_by("index", "t").alias("first"), F.max_by("index", "t").alias("last"))


@plan("w7_trailing_frames", sql("SELECT sequence_id, index, t FROM tracks WHERE t BETWEEN 10 AND 15", "tracks"))
def _w7(spark, d):
    return ln.trailing(a.tracks(spark, d), 15, 5).select("sequence_id", "index", "t")


@plan("j25_parent_position", sql(f"+f AS (SELECT * FROM early QUALIFY row_number() OVER (PARTITION BY label_track ORDER BY t, index) = 1) SELECT f.sequence_id, f.label_track, f.parent_track, f.t, {r('p.center_0', 'from_0')}, {r('p.center_1', 'from_1')}, {r('f.center_0', 'center_0')}, {r('f.center_1', 'center_1')} FROM f JOIN early p ON p.label_track = f.parent_track AND p.t + 1 = f.t", "early"))
def _j25(spark, d):
    return ln.position_before(_early(spark, d))


@plan("p2_lineage_map", sql("SELECT DISTINCT sequence_id, label_track AS label, parent_track AS parent FROM tracks WHERE parent_track > 0 AND parent_track <> label_track", "tracks"))
def _p2(spark, d):
    return ln.lineage_map(a.tracks(spark, d))


for _name in ("f29_clean_tracks", "p1_display_tracks"):

    @plan(_name, sql(f"SELECT t.sequence_id, index, t, CAST(label_track AS INTEGER) AS label, CAST(parent_track AS INTEGER) AS parent, {r('center_0', 'center_0')}, {r('center_1', 'center_1')}, CASE WHEN index % 2 = 0 THEN index % 3 END AS state FROM tracks t", "tracks"))
    def _f29(spark, d):
        t = a.tracks(spark, d)
        states = t.where("index % 2 = 0").select("sequence_id", "index", (F.col("index") % 3).alias("state"))
        return ln.clean(t, states).select("sequence_id", "index", "t", "label", "parent", "center_0", "center_1", "state")


for _name in ("k10_combined_table", "k8_flat_csv_rows"):

    @plan(_name, sql(f"SELECT sequence_id, label_track AS label, t, {r('center_0', 'cy')}, {r('center_1', 'cx')}, coalesce(parent_track, 0) AS parent FROM tracks", "tracks"))
    def _k10(spark, d):
        return ln.combined_table(a.tracks(spark, d))


@plan("k9_states_table", sql("SELECT n.sequence_id, n.index, CAST(n.index % 3 AS INTEGER) AS state, t.label_track, 'tracked' AS label_source FROM (SELECT 'events' AS sequence_id, index FROM nodes) n LEFT JOIN tracks t ON t.index = n.index", "nodes", "tracks"))
def _k9(spark, d):
    n = a.nodes(spark, d).select(F.lit("events").alias("sequence_id"), "index")
    return ln.states_table(n, a.tracks(spark, d).select("sequence_id", "index", "label_track"), (F.col("index") % 3).cast("int"))


@plan("j16_assemble_tracks", sql("+meta AS (SELECT label_track, max(parent_track) AS parent_track FROM tracks WHERE label_track % 3 > 0 GROUP BY ALL) SELECT t.sequence_id, t.index, t.label_track, coalesce(m.parent_track, 0) AS parent_track, 'original' AS cell_source FROM tracks t LEFT JOIN meta m ON m.label_track = t.label_track", "tracks"))
def _j16(spark, d):
    t = a.tracks(spark, d)
    meta = t.where("label_track % 3 > 0").groupBy("sequence_id", "label_track").agg(F.max("parent_track").alias("parent_track"))
    return ln.assemble(t.select("sequence_id", "index"), t, meta)


for _name in ("j17_relabel_masks", "c18_tracked_masks"):

    @plan(_name, sql("SELECT p.sequence_id, p.t, p.y, p.x, CASE WHEN p.label % 3 > 0 THEN p.label + 500 ELSE 0 END AS label FROM pixels p", "pixels"))
    def _j17(spark, d):
        p = a.pixels(spark, d)
        labels = p.where("label % 3 > 0").select("sequence_id", "t", "label").distinct().withColumn("label_track", F.col("label") + 500)
        return ln.relabel_pixels(p, labels).select("sequence_id", "t", "y", "x", "label")


CHAIN = "nexts AS (SELECT index, label_track, lead(index) OVER (PARTITION BY label_track ORDER BY t, index) AS nxt, row_number() OVER (PARTITION BY label_track ORDER BY t, index) AS k, row_number() OVER (PARTITION BY label_track ORDER BY t DESC, index DESC) AS z, parent_track FROM tracks), links AS (SELECT index AS src, nxt AS dst FROM nexts WHERE nxt IS NOT NULL UNION ALL SELECT p.index, d.index FROM nexts d JOIN nexts p ON p.label_track = d.parent_track AND p.z = 1 WHERE d.k = 1 AND d.parent_track > 0 AND d.parent_track <> d.label_track)"


def _forest(spark, d):
    from trackweave.operators.edges import lineage_edges

    t = a.tracks(spark, d)
    return t, lineage_edges(t.withColumnsRenamed({"label_track": "label", "parent_track": "parent"})).select("sequence_id", "src", "dst")


for _name in ("g11_trajectory_labelling", "g11_numbered_labels"):
    _recursive = f"+{CHAIN}, out_n AS (SELECT src, count(*) AS n FROM links GROUP BY src), same AS (SELECT l.src, l.dst FROM links l JOIN out_n o ON o.src = l.src WHERE n = 1), walk(index, start) AS (SELECT index, index FROM tracks WHERE index NOT IN (SELECT dst FROM same) UNION ALL SELECT s.dst, w.start FROM walk w JOIN same s ON s.src = w.index), named AS (SELECT w.index, w.start, p.start AS parent FROM walk w LEFT JOIN links l ON l.dst = w.start LEFT JOIN walk p ON p.index = l.src)"
    _tail = " SELECT 'events' AS sequence_id, index, start, parent FROM named" if _name == "g11_trajectory_labelling" else ", heads AS (SELECT start, row_number() OVER (ORDER BY start) AS k FROM named WHERE index = start) SELECT 'events' AS sequence_id, n.index, h.k AS label_track, coalesce(p.k, 0) AS parent_track FROM named n JOIN heads h ON h.start = n.start LEFT JOIN heads p ON p.start = n.parent"

    @plan(_name, sql(_recursive + _tail, "tracks"))
    def _g11(spark, d, numbered=_name == "g11_numbered_labels"):
        out = ln.trajectories(*_forest(spark, d))
        return ln.numbered_labels(out) if numbered else out


@plan("g10_degree_checks", sql("+u AS (SELECT DISTINCT sequence_id, src, dst FROM dense_preds WHERE y = 1) SELECT sequence_id, dst AS index, 'in' AS side, count(*) AS n FROM u GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT sequence_id, src, 'out', count(*) FROM u GROUP BY ALL HAVING count(*) > 2", "dense_preds"))
def _g10(spark, d):
    return ln.degrees(a.dense_preds(spark, d).where("y = 1").select("sequence_id", "src", "dst").distinct())


@plan("c12_violations", sql(f"+{SPAN}, kid AS (SELECT * FROM span WHERE parent > 0 AND parent <> label_track), j AS (SELECT k.parent, k.label_track, k.b, p.e FROM kid k LEFT JOIN span p ON p.label_track = k.parent), s AS (SELECT parent, count(DISTINCT label_track) AS k, count(DISTINCT b) AS s FROM kid GROUP BY ALL), v AS (SELECT 'gap' AS rule, label_track AS label FROM span WHERE n < e - b + 1 UNION SELECT 'parent missing', parent FROM j WHERE e IS NULL UNION SELECT 'daughters', parent FROM s WHERE k <> 2 UNION SELECT 'starts apart', parent FROM s WHERE s > 1 UNION SELECT 'start after parent', parent FROM j WHERE b <> e + 1 UNION SELECT 'overlap', parent FROM j WHERE b <= e UNION SELECT 'no pixel', label_track FROM tracks WHERE NOT (index % 3 > 0 AND label_track % 11 > 0) OR label_track = 0) SELECT 'events' AS sequence_id, rule, label FROM v", "tracks"))
def _c12(spark, d):
    return c.violations(a.tracks(spark, d), _there(spark, d))


@plan("c13_relatives", sql("+up AS (SELECT DISTINCT label_track AS label, parent_track AS other FROM tracks WHERE parent_track > 0 AND parent_track <> label_track AND parent_track IN (SELECT label_track FROM tracks)) SELECT 'events' AS sequence_id, a.label, 'sibling' AS kind, b.label AS other FROM up a JOIN up b ON b.other = a.other AND b.label <> a.label UNION ALL SELECT 'events', label, 'parent', other FROM up UNION ALL SELECT 'events', other, 'child', label FROM up", "tracks"))
def _c13(spark, d):
    return c.relatives(a.tracks(spark, d))


@plan("u4_shared_frames", sql("SELECT d.sequence_id, p.label_track, d.label_track AS daughter, count(DISTINCT d.t) AS n FROM tracks d JOIN tracks p ON p.label_track = d.parent_track AND p.t = d.t WHERE d.parent_track > 0 AND d.parent_track <> d.label_track GROUP BY ALL", "tracks"))
def _u4(spark, d):
    return c.shared_frames(a.tracks(spark, d))


@plan("u3_lineage_difference", sql("SELECT sequence_id, label_track + t % 2 * 7 AS label_track FROM tracks WHERE index % 2 = 0 EXCEPT SELECT sequence_id, label_track FROM tracks WHERE index % 2 = 1", "tracks"))
def _u3(spark, d):
    t = a.tracks(spark, d)
    one = t.where("index % 2 = 0").select("sequence_id", (F.col("label_track") + F.col("t") % 2 * 7).alias("label_track")).distinct()
    return one.exceptAll(t.where("index % 2 = 1").select("sequence_id", "label_track").distinct())


@plan("u2_distinct_subset", sql("SELECT DISTINCT sequence_id, src, dst FROM preds", "preds"))
def _u2(spark, d):
    return a.preds(spark, d).dropDuplicates(["sequence_id", "src", "dst"]).select("sequence_id", "src", "dst")


@plan("u1_diagonal_concat", sql("SELECT sequence_id, index, t, label_track, CAST(NULL AS BIGINT) AS label FROM tracks UNION ALL SELECT sequence_id, index, t, NULL, label FROM nodes", "tracks", "nodes"))
def _u1(spark, d):
    return a.tracks(spark, d).select("sequence_id", "index", "t", "label_track").unionByName(a.nodes(spark, d).select("sequence_id", "index", "t", "label"), allowMissingColumns=True)


FOOT = "foot AS (SELECT sequence_id, t, label AS owner, y + dy.range AS y, x + dx.range AS x FROM (SELECT sequence_id, t, label, min(y) AS y, min(x) AS x FROM pixels WHERE label % 9 = 1 GROUP BY ALL), range(0, 6) dy, range(0, 6) dx)"


@plan("a17_coverage", sql(f"+{FOOT}, area AS (SELECT sequence_id, t, label, count(*) AS n FROM pixels WHERE label <> 0 GROUP BY ALL), m AS (SELECT f.sequence_id, f.t, owner, p.label, count(*) AS shared FROM foot f JOIN pixels p ON p.sequence_id = f.sequence_id AND p.t = f.t AND p.y = f.y AND p.x = f.x WHERE p.label <> 0 GROUP BY ALL) SELECT m.sequence_id, m.t, owner, m.label, shared, {r('shared / n', 'coverage')}, {r('shared / (36 + n - shared)', 'iou')}, greatest(shared / n, shared / (36 + n - shared)) > 0.5 AS conflict FROM m JOIN area a ON a.sequence_id = m.sequence_id AND a.t = m.t AND a.label = m.label", "pixels"))
def _a17(spark, d):
    p = a.pixels(spark, d)
    corner = p.where("label % 9 = 1").groupBy("sequence_id", "t", F.col("label").alias("owner")).agg(F.min("y").alias("y"), F.min("x").alias("x"))
    grid = corner.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return c.coverage(p, grid.select("sequence_id", "t", "owner", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")))


BOUNDS = "bounds AS (SELECT sequence_id, t, max(y) + 1 AS height, max(x) + 1 AS width FROM pixels GROUP BY ALL), spots AS (SELECT b.sequence_id, b.t, CAST(y.range AS INTEGER) AS y, CAST(x.range AS INTEGER) AS x FROM bounds b, range(0, 600) y, range(0, 200) x WHERE y.range < b.height AND x.range < b.width), free AS (SELECT f.* FROM spots f LEFT JOIN pixels p ON p.sequence_id = f.sequence_id AND p.t = f.t AND p.y = f.y AND p.x = f.x AND p.label <> 0 WHERE p.label IS NULL)"


@plan("l5_nearest_background", sql(f"+{BOUNDS}, c AS (SELECT sequence_id, t, label AS id, min(y) AS cy, min(x) AS cx FROM pixels GROUP BY ALL), near AS (SELECT c.sequence_id, c.t, id, min((free.y - cy) * (free.y - cy) * 1000000000000 + (free.x - cx) * (free.x - cx) * 1000000000000 + free.y * 1000000 + free.x) AS best FROM c JOIN free ON free.sequence_id = c.sequence_id AND free.t = c.t GROUP BY ALL) SELECT sequence_id, t, id, CAST(best // 1000000 % 1000000 AS INTEGER) AS y, CAST(best % 1000000 AS INTEGER) AS x FROM near", "pixels"))
def _l5(spark, d):
    p = a.pixels(spark, d)
    corners = p.groupBy("sequence_id", "t", F.col("label").alias("id")).agg(F.min("y").alias("cy"), F.min("x").alias("cx"))
    return markers.nearest_free(p, markers.frames_of(p), corners).drop("rank")


@plan("g12_placed_markers")
def _g12_placed(spark, d):
    """A pixel of its own for each row that a trajectory lacks, where others of its frame have theirs."""
    t = a.tracks(spark, d)
    pixels = t.select("sequence_id", "t", F.floor("center_0").cast("int").alias("y"), F.floor("center_1").cast("int").alias("x"), F.col("label_track").alias("label"))
    missing = c.missing_markers(t).select("sequence_id", "t", F.col("label_track").alias("id"), F.col("from_0").alias("cy"), F.col("from_1").alias("cx"))
    return markers.placed_markers(pixels, markers.frames_of(pixels), missing)


@plan("a18_intensity_spread", sql(f"+s AS (SELECT sequence_id, t AS id, stddev_pop(intensity) FILTER (WHERE x % 3 = 0) AS g, stddev_pop(intensity) FILTER (WHERE x % 3 = 1) AS r, stddev_pop(intensity) FILTER (WHERE x % 3 = 2) AS b FROM pixels GROUP BY ALL) SELECT sequence_id, id, {r('CASE WHEN r - b <= 1e-6 THEN 1.0 ELSE (g - b) / (r - b) END', 'score')} FROM s WHERE g IS NOT NULL AND r IS NOT NULL AND b IS NOT NULL", "pixels"))
def _a18(spark, d):
    p = a.pixels(spark, d).withColumn("id", F.col("t"))
    return c.spread_score(*(p.where(f"x % 3 = {k}") for k in range(3)))


@plan("g12_missing_markers", sql(f"+{SPAN}, e AS (SELECT s.sequence_id, s.label_track, CAST(k.range AS INTEGER) AS t FROM span s, range(0, 400) k WHERE k.range BETWEEN b AND e) SELECT e.sequence_id, e.label_track, e.t, {r('arg_max(p.center_0, p.t)', 'from_0')}, {r('arg_max(p.center_1, p.t)', 'from_1')} FROM e JOIN tracks p ON p.label_track = e.label_track AND p.t < e.t WHERE NOT EXISTS (SELECT 1 FROM tracks x WHERE x.label_track = e.label_track AND x.t = e.t) GROUP BY ALL", "tracks"))
def _g12(spark, d):
    return c.missing_markers(a.tracks(spark, d))


@plan("l1_sorted_links", sql("SELECT sequence_id, src, dst, rank() OVER (PARTITION BY sequence_id ORDER BY src, dst) AS place FROM (SELECT DISTINCT sequence_id, src, dst FROM preds)", "preds"))
def _l1(spark, d):
    return numbered(a.preds(spark, d).select("sequence_id", "src", "dst").distinct(), "place", "src", "dst")


@plan("l2_mixed_sort", sql("+u AS (SELECT sequence_id, src, dst, max(round(p2, 6)) AS p2 FROM dense_preds GROUP BY ALL) SELECT sequence_id, src, dst, row_number() OVER (PARTITION BY sequence_id ORDER BY p2 DESC, src, dst) AS place FROM u", "dense_preds"))
def _l2(spark, d):
    df = a.dense_preds(spark, d).groupBy("sequence_id", "src", "dst").agg(F.max(F.round("p2", 6)).alias("p2"))
    return numbered(df, "place", -F.col("p2"), "src", "dst").select("sequence_id", "src", "dst", "place")
