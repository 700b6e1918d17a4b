"""Connected components of a link table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, salted_join


def components(links: DataFrame) -> DataFrame:
    """(node, label): for every node of links (a, b), the least node it can be reached from.

    Each round takes the least label among a node's neighbours and then the label of its label, so a chain of n
    nodes needs about log n rounds. Every round is written to the shared folder. Rows with a hot label are dealt by
    salt. Links may repeat and may be loops; an empty table gives no rows; null ends are left out.
    """
    links = links.where("a is not null and b is not null")
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        near = labels.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # Only what is a label is looked up, so that few rows are copied for the salts.
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next")).join(labels.select("label").distinct(), "label", "left_semi")
        stepped = salted_join(near, jump, ["label"], by=F.col("node")).select("node", "was", F.least("label", "next").alias("label"))
        stepped = materialize(stepped, "labels")
        labels = stepped.select("node", "label")
        if stepped.where("label != was").isEmpty():
            return labels
