"""Connected components of links within sequences, by least labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators.lineage import _written

SEQ = "sequence_id"


def components(links: DataFrame) -> DataFrame:
    """(sequence_id, index, component): for each end of links (sequence_id, src, dst) the least index it is joined with.

    A round takes the least label around a node and then that label's own, so a chain of n needs about log n rounds;
    each is written. Links of a hot node are reduced to a minimum before they are shuffled. Labels are merged in joins: by
    the size of their compressed files Spark would send millions of them through the driver."""
    way = lambda a, b: F.struct(F.col(a).alias("index"), F.col(b).alias("other"))
    both = links.select(SEQ, F.inline(F.array(way("src", "dst"), way("dst", "src"))))  # a union would make the links twice
    both = _written(both.distinct(), "links")
    labels = _written(both.groupBy(SEQ, "index").agg(F.least(F.col("index"), F.min("other")).alias("component")), "labels").hint("merge")
    while True:
        near = both.join(labels.withColumnRenamed("index", "other"), [SEQ, "other"]).groupBy(SEQ, "index").agg(F.min("component").alias("near"))
        given = labels.join(near, [SEQ, "index"]).select(SEQ, "index", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(SEQ, F.col("index").alias("component"), F.col("component").alias("next"))
        given = _written(given.join(jump, [SEQ, "component"]).select(SEQ, "index", "was", F.least("component", "next").alias("component")), "labels")
        labels = given.select(SEQ, "index", "component").hint("merge")
        if given.where("component != was").isEmpty():
            return labels


#: Links that a task of ``spanning`` holds besides what it has found so far.
BUFFER = 1_000_000


def least_joined(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node it is joined with) of all ends of the links."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d, label = at[: len(src)], at[len(src) :], np.arange(len(nodes))
    while len(s):
        low = np.minimum(label[s], label[d])
        np.minimum.at(label, label[s], low)
        np.minimum.at(label, label[d], low)
        while not np.array_equal(label, following := label[label]):
            label = following
        apart = label[s] != label[d]
        s, d = s[apart], d[apart]
    return nodes, nodes[label]


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    count: dict = {}

    def reduced(seq) -> None:
        held[seq] = [least_joined(np.concatenate([s for s, _ in held[seq]]), np.concatenate([d for _, d in held[seq]]))]
        count[seq] = 0

    schema = None
    for batch in batches:
        schema = batch.schema
        names = batch.column(0).dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        src, dst = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        for k, seq in enumerate(names.dictionary.to_pylist()):
            own = code == k
            held.setdefault(seq, []).append((src[own], dst[own]))
            count[seq] = count.get(seq, 0) + int(own.sum())
        if sum(count.values()) > BUFFER:
            for seq in [x for x, n in count.items() if n]:
                reduced(seq)
    for seq in held:
        reduced(seq)
        nodes, least = held[seq][0]
        for at in range(0, len(nodes), 100_000):
            part = nodes[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([seq] * len(part), schema.field(0).type), pa.array(part), pa.array(least[at : at + 100_000])], schema=schema)


def spanning(links: DataFrame) -> DataFrame:
    """Links (sequence_id, src, dst), numbers, that join the same nodes: in each partition every node with the least one that
    the partition's links join it with. They are as many as a partition's nodes, however many links these have, so rounds
    over them grow with the nodes. A task holds its nodes and a buffer of links."""
    given = links.where(f"{SEQ} is not null and src is not null and dst is not null").select(SEQ, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return given.mapInArrow(_spanning, given.schema)
