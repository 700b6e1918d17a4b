"""Plans over the chain of repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.operators import chain
from trackweave.operators.correction import violations
from trackweave.operators.pixels import normalised_channels
from trackweave.operators.scores import tracking_quality
from trackweave.plans.ddb import r, sql
from trackweave.plans.registry import plan
from trackweave.sources import adapters as a


def _state(spark, d):
    """Tracks with a mask of 3 x 3 pixels each, on a coarse grid so that masks meet."""
    t = a.tracks(spark, d).where("label_track > 0")
    grid = t.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(2))))
    at = lambda c, o: (F.floor(F.col(c) / 3) * 3 + F.col(o)).cast("int")
    pixels = grid.select("sequence_id", "t", at("center_0", "dy").alias("y"), at("center_1", "dx").alias("x"), "label_track").groupBy("sequence_id", "t", "y", "x").agg(F.min("label_track").alias("label"))
    preds = t.select("sequence_id", F.col("index").alias("src"), (F.col("index") + 1).alias("dst"), F.lit(0.5).alias("p1"), F.lit(0.1).alias("p2"))
    return chain.State(t, pixels, preds)


MASKS = "own AS (SELECT * FROM tracks WHERE label_track > 0), px AS (SELECT sequence_id, t, CAST(floor(center_0 / 3) * 3 + dy.range AS INTEGER) AS y, CAST(floor(center_1 / 3) * 3 + dx.range AS INTEGER) AS x, min(label_track) AS label FROM own, range(0, 3) dy, range(0, 3) dx GROUP BY ALL), holes AS (SELECT sequence_id, label_track AS label, t, lead(t) OVER (PARTITION BY label_track ORDER BY t) AS next_t FROM own QUALIFY next_t - t > 1), foot AS (SELECT p.sequence_id, CAST(k.range AS INTEGER) AS t, y, x, p.label FROM px p JOIN holes h ON h.label = p.label AND h.t = p.t, range(0, 400) k WHERE k.range > h.t AND k.range < h.next_t)"


@plan("c2_gap_masks", sql(f"+{MASKS} SELECT * FROM foot", "tracks"))
def _c2(spark, d):
    return chain.gap_masks(_state(spark, d))


@plan("c2_conflicts", sql(f"+{MASKS}, size AS (SELECT t, label, count(*) AS n FROM foot GROUP BY ALL), area AS (SELECT t, label, count(*) AS n FROM px GROUP BY ALL), m AS (SELECT f.t, f.label, p.label AS other, count(*) AS k FROM foot f JOIN px p ON p.t = f.t AND p.y = f.y AND p.x = f.x GROUP BY ALL) SELECT DISTINCT 'events' AS sequence_id, m.t, m.label FROM m JOIN size s ON s.t = m.t AND s.label = m.label JOIN area a ON a.t = m.t AND a.label = m.other WHERE greatest(k / a.n, k / (s.n + a.n - k)) > 0.5", "tracks"))
def _conflicts(spark, d):
    return chain.conflicts(_state(spark, d))


@plan("c1_correction_chain")
def _c1(spark, d):
    """The corrected tracks; corrected is false where a sequence's repairs break a rule, so that its rows are the given
    ones. A repair that fails is an error of the query."""
    done = chain.correct(_state(spark, d), strict=True)
    kept = done.uncorrected.select("sequence_id", F.lit(False).alias("corrected")).distinct()
    rows = done.tracks.join(kept, "sequence_id", "left").withColumn("corrected", F.coalesce("corrected", F.lit(True)))
    return rows.select("sequence_id", "index", "t", "label_track", "parent_track", "cell_source", "corrected")


@plan("c15_failure_isolation", sql("SELECT sequence_id, index, t, label_track FROM tracks WHERE label_track > 0", "tracks"))
def _c15(spark, d):
    def fails(state):
        raise RuntimeError("a stage that fails")

    return chain.correct(_state(spark, d), [fails]).tracks.select("sequence_id", "index", "t", "label_track")


def _sequences(spark, d):
    """The state dealt to eight sequences; in the odd ones each trajectory is the only daughter of another, which breaks a rule."""
    s = _state(spark, d)
    named = lambda label: F.concat(F.lit("s"), (F.col(label) % 8).cast("string"))
    tracks = s.tracks.withColumns({"parent_track": F.when(F.col("label_track") % 2 == 1, F.col("label_track") + 8).otherwise(0), "sequence_id": named("label_track")})
    return chain.State(tracks, s.pixels.withColumn("sequence_id", named("label")), s.preds.withColumn("sequence_id", F.concat(F.lit("s"), (F.col("src") % 8).cast("string"))))


@plan("c1_sequences_corrected", sql("+u AS (SELECT DISTINCT label_track AS l FROM tracks WHERE label_track > 0) SELECT 's' || (l % 8) AS sequence_id, bool_and(l % 2 = 0 OR l + 8 NOT IN (SELECT l FROM u)) AS valid FROM u GROUP BY 1", "tracks"))
def _c1_sequences(spark, d):
    """Which sequences break no rule behind the chain; the others have kept what was given. A repair that fails is an
    error of the query."""
    given = _sequences(spark, d)
    broken = chain.correct(given, strict=True).uncorrected.select("sequence_id").distinct().withColumn("valid", F.lit(False))
    return given.tracks.select("sequence_id").distinct().join(broken, "sequence_id", "left").select("sequence_id", F.coalesce("valid", F.lit(True)).alias("valid"))


@plan("c1_violations_left")
def _left(spark, d):
    done = chain.correct(_sequences(spark, d), strict=True)
    return violations(done.tracks, done.pixels)


@plan("c2_resolved_gaps")
def _c2_resolved(spark, d):
    """All gaps of up to two frames, contended ones folded: rows with where they come from."""
    return chain.close_gaps(resolve=True)(_state(spark, d)).tracks.select("sequence_id", "index", "t", "label_track", "center_0", "center_1", "cell_source")


@plan("a23_detection_quality", sql(f"+{MASKS}, res AS (SELECT t, y, x, label FROM px WHERE (y + x) % 3 > 0), area AS (SELECT t, label, count(*) AS n FROM px GROUP BY ALL), m AS (SELECT p.t, p.label, r.label AS found, count(*) AS k FROM px p JOIN res r ON r.t = p.t AND r.y = p.y AND r.x = p.x GROUP BY ALL), g AS (SELECT m.* FROM m JOIN area a ON a.t = m.t AND a.label = m.label WHERE 2 * k > n) SELECT 'events' AS sequence_id, (SELECT count(*) FROM area) AS objects_true, (SELECT count(DISTINCT (t, label)) FROM res) AS objects_found, (SELECT count(*) FROM g) AS matches, (SELECT count(DISTINCT (t, found)) FROM g) AS found_matched", "tracks"))
def _a23(spark, d):
    s = _state(spark, d)
    return chain.detection_quality(s.pixels, s.pixels.where("(y + x) % 3 > 0"))


LINKS = "{0}_links AS (SELECT sequence_id, t, label_track AS label, lead(t) OVER w AS to_t, label_track AS to_label, 'track' AS kind FROM (SELECT DISTINCT sequence_id, t, label_track FROM {1}) WINDOW w AS (PARTITION BY sequence_id, label_track ORDER BY t) QUALIFY to_t IS NOT NULL UNION ALL SELECT b.sequence_id, e.t, b.up, b.t, b.label_track, 'parent' FROM (SELECT sequence_id, label_track, min(t) AS t, max(parent_track) AS up FROM {1} GROUP BY ALL) b JOIN (SELECT sequence_id, label_track, max(t) AS t FROM {1} GROUP BY ALL) e ON e.label_track = b.up WHERE b.up > 0 AND b.up <> b.label_track)"
RESULT = "res AS (SELECT sequence_id, t, y, x, CASE WHEN label % 5 = 0 AND t > 20 THEN label + 100000 WHEN label % 7 = 0 THEN label + 1 ELSE label END AS label FROM px WHERE (y + x) % 3 > 0 AND (label % 11 > 0 OR t % 4 > 0)), made AS (SELECT DISTINCT o.sequence_id, o.t, CASE WHEN label_track % 5 = 0 AND o.t > 20 THEN label_track + 100000 WHEN label_track % 7 = 0 THEN label_track + 1 ELSE label_track END AS label_track, CASE WHEN label_track % 5 = 0 AND o.t > 20 THEN label_track ELSE parent_track END AS parent_track FROM own o WHERE label_track % 11 > 0 OR o.t % 4 > 0)"


def _result(state):
    """A result with errors of each kind: masks that shrink, trajectories cut and called daughters, two that share a
    name, cells that are missing."""
    name = lambda label: F.when((F.col(label) % 5 == 0) & (F.col("t") > 20), F.col(label) + 100000).when(F.col(label) % 7 == 0, F.col(label) + 1).otherwise(F.col(label))
    pixels = state.pixels.where("(y + x) % 3 > 0 and (label % 11 > 0 or t % 4 > 0)").withColumn("label", name("label"))
    rows = state.tracks.where("label_track % 11 > 0 or t % 4 > 0")
    parent = F.when((F.col("label_track") % 5 == 0) & (F.col("t") > 20), F.col("label_track")).otherwise(F.col("parent_track"))
    return rows.select("sequence_id", "t", parent.alias("parent_track"), name("label_track").alias("label_track")).distinct(), pixels


@plan("a23_tracking_quality", sql(f"""+{MASKS}, {RESULT}, {LINKS.format('true', 'own')}, {LINKS.format('made', 'made')},
area AS (SELECT t, label, count(*) AS n FROM px GROUP BY ALL), have AS (SELECT DISTINCT t, label AS found FROM res),
met AS (SELECT p.t, p.label, r.label AS found, count(*) AS k FROM px p JOIN res r ON r.t = p.t AND r.y = p.y AND r.x = p.x GROUP BY ALL),
good AS (SELECT m.t, m.label, m.found, count(*) OVER (PARTITION BY m.t, m.found) AS shared FROM met m JOIN area a ON a.t = m.t AND a.label = m.label WHERE 2 * m.k > a.n),
single AS (SELECT * FROM good WHERE shared = 1),
mapped AS (SELECT a.t, a.label, b.t AS to_t, b.label AS to_label, l.kind AS has FROM made_links l JOIN single a ON a.t = l.t AND a.found = l.label JOIN single b ON b.t = l.to_t AND b.found = l.to_label),
linked AS (SELECT l.kind, m.has FROM true_links l FULL JOIN mapped m ON m.t = l.t AND m.label = l.label AND m.to_t = l.to_t AND m.to_label = l.to_label),
n AS (SELECT (SELECT count(*) FROM area) AS nodes, (SELECT count(*) FROM area a WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.t = a.t AND g.label = a.label)) AS missing, (SELECT count(*) FROM have h WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.t = h.t AND g.found = h.found)) AS spurious,
 (SELECT count(*) - count(DISTINCT (t, found)) FROM good) AS splits, (SELECT count(kind) FROM linked) AS links, (SELECT count(*) FILTER (WHERE kind IS NULL) FROM linked) AS redundant_links, (SELECT count(*) FILTER (WHERE has IS NULL) FROM linked) AS missing_links, (SELECT count(*) FILTER (WHERE kind <> has) FROM linked) AS wrong_links),
cost AS (SELECT *, 5.0 * splits + 10.0 * missing + spurious AS of_nodes, redundant_links + 1.5 * missing_links + wrong_links AS of_links FROM n)
SELECT 'events' AS sequence_id, nodes, missing, spurious, splits, links, redundant_links, missing_links, wrong_links, {r('1 - least(of_nodes, 10.0 * nodes) / (10.0 * nodes)', 'det')}, {r('1 - least(of_links, 1.5 * links) / (1.5 * links)', 'lnk')}, {r('1 - least(of_nodes + of_links, 10.0 * nodes + 1.5 * links) / (10.0 * nodes + 1.5 * links)', 'tra')} FROM cost""", "tracks"))
def _tracking(spark, d):
    s = _state(spark, d)
    return tracking_quality((s.tracks, s.pixels), _result(s)).drop("valid")


@plan("n4_normalised_channels", sql(f"SELECT sequence_id, t, y, x, {r('(intensity - 0.485) / 0.229', 'channel_0')}, {r('(intensity - 0.456) / 0.224', 'channel_1')}, {r('(intensity - 0.406) / 0.225', 'channel_2')} FROM pixels", "pixels"))
def _n4(spark, d):
    return normalised_channels(a.pixels(spark, d)).drop("label", "intensity")
