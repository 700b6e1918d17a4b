"""How well tracks agree with the truth: the least cost of turning one lineage graph into the other. A23."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.operators.correction import violations

SEQ = "sequence_id"
#: Published weights of the tracking measure, for splitting a node, adding and deleting one, deleting and
#: adding a link and changing its kind.
SPLIT, MISSING, SPURIOUS, REDUNDANT_LINK, MISSING_LINK, WRONG_LINK = 5.0, 10.0, 1.0, 1.0, 1.5, 1.0


def matched_nodes(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(sequence_id, t, label, found, shared_by): true masks of which a found one has more than half, and how many true
    ones that found one has. Both tables are pixels."""
    own = truth.where("label != 0").select(SEQ, "t", "y", "x", "label")
    area = own.groupBy(SEQ, "t", "label").agg(F.count(F.lit(1)).alias("_a"))
    met = own.join(found.where("label != 0").select(SEQ, "t", "y", "x", F.col("label").alias("found")), [SEQ, "t", "y", "x"]).groupBy(SEQ, "t", "label", "found").agg(F.count(F.lit(1)).alias("_n"))
    good = met.join(area, [SEQ, "t", "label"]).where("2 * _n > _a").select(SEQ, "t", "label", "found")
    return good.withColumn("shared_by", F.count(F.lit(1)).over(Window.partitionBy(SEQ, "t", "found")))


def lineage_links(tracks: DataFrame) -> DataFrame:
    """(sequence_id, t, label, to_t, to_label, kind): the links of a lineage. track: to a trajectory's next row; parent:
    from a parent's last row to its daughter's first."""
    rows = tracks.select(SEQ, "t", F.col("label_track").alias("label")).distinct()
    after = F.lead("t").over(Window.partitionBy(SEQ, "label").orderBy("t"))
    along = rows.withColumn("to_t", after).where("to_t is not null").select(SEQ, "t", "label", "to_t", F.col("label").alias("to_label"), F.lit("track").alias("kind"))
    first = tracks.groupBy(SEQ, F.col("label_track").alias("to_label")).agg(F.min("t").alias("to_t"), F.max("parent_track").alias("label")).where("label > 0 and label != to_label")
    last = tracks.groupBy(SEQ, F.col("label_track").alias("label")).agg(F.max("t").alias("t"))
    return along.unionByName(first.join(last, [SEQ, "label"]).select(SEQ, "t", "label", "to_t", "to_label", F.lit("parent").alias("kind")))


def tracking_quality(truth: tuple[DataFrame, DataFrame], found: tuple[DataFrame, DataFrame]) -> DataFrame:
    """For each sequence of the truth the edits that its result needs, and scores of 1 for none. Both are (tracks, pixels).

    splits: found masks that hold several true ones, less one each; missing: true masks that no found one has more than
    half of; spurious: found masks without such; links count between masks matched one to one: redundant_links are not
    in the truth, wrong_links are of the other kind, missing_links are true ones that the result lacks. det, lnk and tra
    weigh nodes, links and all of them against the cost of making the truth from nothing, and are not below 0. valid:
    the result breaks no rule of a lineage."""
    nodes = truth[1].where("label != 0").select(SEQ, "t", "label").distinct()
    have = found[1].where("label != 0").select(SEQ, "t", F.col("label").alias("found")).distinct()
    good = matched_nodes(truth[1], found[1])
    count = lambda df, name: df.groupBy(SEQ).agg(F.count(F.lit(1)).alias(name))
    takers = good.select(SEQ, "t", "found", "shared_by").distinct()
    parts = [count(nodes, "nodes"), count(nodes.join(good, [SEQ, "t", "label"], "left_anti"), "missing"), count(have.join(takers, [SEQ, "t", "found"], "left_anti"), "spurious")]
    parts.append(takers.groupBy(SEQ).agg(F.sum(F.col("shared_by") - 1).alias("splits")))
    single = good.where("shared_by = 1").select(SEQ, "t", "found", "label")
    true_links = lineage_links(truth[0])
    links = lineage_links(found[0]).select(SEQ, F.col("t"), F.col("label").alias("found"), "to_t", F.col("to_label").alias("to_found"), F.col("kind").alias("has"))
    links = links.join(single, [SEQ, "t", "found"]).join(single.select(SEQ, F.col("t").alias("to_t"), F.col("found").alias("to_found"), F.col("label").alias("to_label")), [SEQ, "to_t", "to_found"])
    both = true_links.join(links.select(SEQ, "t", "label", "to_t", "to_label", "has"), [SEQ, "t", "label", "to_t", "to_label"], "full")
    one = lambda when: F.count_if(when)
    parts.append(both.groupBy(SEQ).agg(
        one(F.col("kind").isNotNull()).alias("links"), one(F.col("kind").isNull()).alias("redundant_links"), one(F.col("has").isNull()).alias("missing_links"), one(F.col("kind") != F.col("has")).alias("wrong_links"),
    ))
    broken = violations(*found).select(SEQ).distinct().withColumn("valid", F.lit(False))
    out = parts[0]
    for part in [*parts[1:], broken]:
        out = out.join(part, SEQ, "left")
    names = ["nodes", "missing", "spurious", "splits", "links", "redundant_links", "missing_links", "wrong_links"]
    out = out.select(SEQ, *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names), F.coalesce("valid", F.lit(True)).alias("valid"))
    c = F.col
    of_nodes = c("splits") * SPLIT + c("missing") * MISSING + c("spurious") * SPURIOUS
    of_links = c("redundant_links") * REDUNDANT_LINK + c("missing_links") * MISSING_LINK + c("wrong_links") * WRONG_LINK
    whole = lambda cost, most: F.when(most > 0, 1 - F.least(cost, most) / most).otherwise(F.when(cost > 0, 0.0).otherwise(1.0))
    return out.withColumns({"det": whole(of_nodes, c("nodes") * MISSING), "lnk": whole(of_links, c("links") * MISSING_LINK), "tra": whole(of_nodes + of_links, c("nodes") * MISSING + c("links") * MISSING_LINK)})
