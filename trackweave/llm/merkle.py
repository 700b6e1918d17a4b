"""Merkle manifest of a dataset by time-forward processing.

Rows are leaves, ordered within their group; a group's tree ends in its subroot, and the subroots, ordered by group,
are the leaves of the tree that ends in the root. Trees are cut into blocks of BLOCK consecutive nodes: a sweep over a
block's nodes in the order of their labels (the last leaf below, then the level) takes a node's children from a
priority queue and puts the node's digest there for its parent, so that at most one message a level waits. The roots of
blocks are the next round's nodes; between rounds Spark's shuffle is the external queue. When single nodes remain, the
rounds run in reverse: each block gets the proof of its root as a message that stands before its nodes, and deals it
out, extended by the siblings within the block, until the leaves have theirs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, spark_parts

#: Nodes of a block, as a power of two.
BLOCK_BITS = 12


def serialized(*fields: Column) -> Column:
    """Fields one after another: - for null, else the UTF-8 byte count, a colon and the value."""
    return F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (f.cast("string") for f in fields)))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(serialized(*fields), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to. A step of a proof is l or r and the digest that stands to the left
    or right, or empty where a node has no sibling."""

    def step(digest: Column, sibling: Column) -> Column:
        other = F.substring(sibling, 2, 64)
        return F.sha2(F.when(sibling.startswith("l"), F.concat(other, digest)).when(sibling.startswith("r"), F.concat(digest, other)).otherwise(digest), 256)

    return F.aggregate(proof, leaf, step)


def siblings_digest(proof: Column) -> Column:
    """sha256 of the proof's siblings, from the leaf's up."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""), 256)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with pos, from 0 within each tree by ``order``, and n, the tree's rows. Rows are dealt out by ranges of
    tree and order, so that a large tree is many tasks; ranges' counts, few for each task, give the offsets."""
    parts = materialize(rows.repartitionByRange(spark_parts(rows), tree, *order).withColumn("__tw_part", F.spark_partition_id()), "merkle-order")
    counts = parts.groupBy(tree, "__tw_part").agg(F.count(F.lit(1)).alias("__tw_n"))
    within = Window.partitionBy(tree)
    before = F.coalesce(F.sum("__tw_n").over(within.orderBy("__tw_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(tree, "__tw_part", before.alias("__tw_before"), F.sum("__tw_n").over(within).alias("n"))
    own = F.row_number().over(Window.partitionBy(tree, "__tw_part").orderBy(*order))
    return parts.withColumn("__tw_own", own).join(offsets.hint("shuffle_hash"), [tree, "__tw_part"]).withColumn("pos", F.col("__tw_own") - 1 + F.col("__tw_before")).drop("__tw_part", "__tw_own", "__tw_before")


def _levels(n: int) -> int:
    return (n - 1).bit_length()


def sweep(digests: Iterator[tuple[int, bytes]], n: int, levels: int) -> Iterator[tuple[int, int, bytes]]:
    """(level, index, digest) of all nodes above consecutive leaves (index, digest) of a tree of n, up to ``levels``.

    Nodes are taken in the order of their labels. The queue holds what children have sent to nodes whose turn has not
    come; it has a message a level at most, two where a parent is next."""
    queue: list[tuple[int, int, int, bytes]] = []  # label of the receiver (last leaf, level), the sender's index, digest

    def send(level: int, index: int, digest: bytes) -> None:
        if level < levels:
            last = min(((index >> 1) + 1 << level + 1) - 1, n - 1)
            heapq.heappush(queue, (last, level + 1, index, digest))

    for at, leaf in digests:
        send(0, at, leaf)
        while queue and queue[0][0] <= at:
            last, level, index, got = heapq.heappop(queue)
            while queue and queue[0][:2] == (last, level):
                got += heapq.heappop(queue)[3]
            made = sha256(got).hexdigest().encode()
            yield level, index >> 1, made
            send(level, index >> 1, made)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """(tree, block, rows) of consecutive rows with equal tree and block."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        trees, blocks = batch.column("tree").to_pylist(), batch.column("block").to_pylist()
        begin = 0
        for i in range(len(trees) + 1):
            if i == len(trees) or (trees[i], blocks[i]) != name:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if i < len(trees):
                    if held:
                        yield *name, pa.Table.from_batches(held)
                    held, name, begin = [], (trees[i], blocks[i]), i
    if held:
        yield *name, pa.Table.from_batches(held)


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Rows dealt out by block, each block's together and in order."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _up(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, rows in _grouped(batches):
            n, pos = rows["n"][0].as_py(), rows["pos"].to_pylist()
            levels = min(bits, _levels(n))
            top = rows["digest"][0].as_py().encode()
            for _, _, top in sweep(zip(pos, (d.encode() for d in rows["digest"].to_pylist()), strict=True), n, levels):
                pass
            yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([block], pa.int64()), pa.array([(n - 1 >> bits) + 1], pa.int64()), pa.array([top.decode()])], names=["tree", "pos", "n", "digest"])

    return run


def climb(nodes: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds' nodes (tree, pos, n, digest) from the leaves up, and (tree, digest): the trees' roots."""
    rounds = [nodes]
    while True:
        given = rounds[-1]
        high = given.agg(F.max("n")).first()[0] or 0
        if high <= 1:
            return rounds, given.select("tree", "digest")
        blocked = given.select("tree", F.shiftright("pos", bits).alias("block"), "pos", "n", "digest")
        rounds.append(materialize(_in_blocks(blocked).mapInArrow(_up(bits), "tree string, pos long, n long, digest string"), "merkle-round"))


def _proofs(bits: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in _grouped(batches):
            # The message for the block stands before its nodes.
            above, message = rows["above"][0].as_py(), rows.slice(0, 1)
            rows = rows.slice(1).combine_chunks()
            n, pos = rows["n"][0].as_py(), rows["pos"].to_pylist()
            levels = min(bits, _levels(n))
            leaves = list(zip(pos, (d.encode() for d in rows["digest"].to_pylist()), strict=True))
            made = {(0, i): d for i, d in leaves} | {(level, i): d for level, i, d in sweep(iter(leaves), n, levels)}
            # In falling order of labels: parents before children.
            proofs: dict[tuple[int, int], list[str]] = {(levels, pos[0] >> levels): above}
            for level in range(levels - 1, -1, -1):
                for i in range(pos[0] >> level, (pos[-1] >> level) + 1):
                    other = made.get((level, i ^ 1))
                    side = "" if other is None else ("l" if i & 1 else "r") + other.decode()
                    proofs[level, i] = [side, *proofs[level + 1, i >> 1]]
                for i in range(pos[0] >> level + 1, (pos[-1] >> level + 1) + 1):
                    del proofs[level + 1, i]
            proof = pa.array([proofs[0, i] for i in pos], pa.list_(pa.string()))
            roots = {c: pa.repeat(message[c][0], len(pos)) for c in ("subroot", "root")}
            yield pa.RecordBatch.from_arrays([proof if c == "proof" else roots[c] if c in roots else rows[c].chunk(0) for c in names], names=names)

    return run


def descend(rounds: list[DataFrame], tops: DataFrame, bits: int, carry: list[str]) -> DataFrame:
    """The leaves of ``rounds``[0] (tree, digest, the columns in carry) with proof, subroot and root, from the messages
    (tree, above, subroot, root) to the trees' roots."""
    messages = tops.select("tree", F.lit(0).cast("long").alias("block"), "above", "subroot", "root")
    for k in range(len(rounds) - 1, -1, -1):
        last = k == 0
        keep = ["tree", "pos", "n", "digest", *(carry if last else [])]
        nodes = rounds[k].select(*keep)
        if k == len(rounds) - 1:  # single nodes: each its tree's root
            found = nodes.join(messages.drop("block").hint("shuffle_hash"), "tree").withColumnRenamed("above", "proof")
        else:
            both = nodes.withColumn("block", F.shiftright("pos", bits)).unionByName(messages.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
            names = [*keep, "proof", "subroot", "root"]
            kinds = [f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in keep] + ["proof array<string>", "subroot string", "root string"]
            found = _in_blocks(both).mapInArrow(_proofs(bits, names), ", ".join(kinds))
        if last:
            return found.select("tree", "digest", *carry, "proof", "subroot", "root")
        messages = materialize(found.select("tree", F.col("pos").alias("block"), F.col("proof").alias("above"), "subroot", "root"), "merkle-messages")
    raise AssertionError


def manifest(docs: DataFrame, ident: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), bits: int = BLOCK_BITS, **carry: Column) -> DataFrame:
    """ident, leaf, subroot, root, proof and the columns in ``carry`` (over ``docs``) for each row of ``docs``.

    A leaf is the digest of the row's ``fields``, serialized. In each group leaves ascend by ident, null first; equal
    idents by leaf. While nodes remain, every two consecutive ones (the last may be alone) become the digest of their
    digests; a lone leaf is its group's subroot. Subroots, by group as text, null first, give the root likewise. proof:
    for each level from the leaf up l or r and the sibling's digest, or an empty text where there is none, through the
    subroot to the root; ``folded`` follows it.

    Null fields and null group: as serialized. Rows that repeat are leaves each, in any order among themselves. Texts of
    any length are digested where they are and not moved. Empty table: no rows. Digests are hexadecimal.
    """
    own = {"tree": F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("")), "digest": leaf_digest(*map(F.col, fields)), "__tw_i": F.col(ident), "__tw_u": F.monotonically_increasing_id()}
    extra = {f"__tw_c{i}": c for i, c in enumerate(carry.values())}
    leaves = materialize(docs.select(*(c.alias(k) for k, c in (own | extra).items())), "merkle-leaves")
    leaves = materialize(numbered(leaves, "tree", ["__tw_i", "digest", "__tw_u"]).drop("__tw_u"), "merkle-numbered")
    rounds, subroots = climb(leaves, bits)
    groups = materialize(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("__tw_g"), "digest"), "tree", ["__tw_g"]), "merkle-groups")
    upper, roots = climb(groups, bits)
    none = F.array().cast("array<string>")
    root = roots.select("tree", none.alias("above"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    tops = descend(upper, root, bits, ["__tw_g"])
    tops = tops.select(F.col("__tw_g").alias("tree"), F.col("proof").alias("above"), F.col("digest").alias("subroot"), "root")
    out = descend(rounds, tops, bits, ["__tw_i", *extra])
    return out.select(F.col("__tw_i").alias(ident), F.col("digest").alias("leaf"), "subroot", "root", "proof", *(F.col(f"__tw_c{i}").alias(k) for i, k in enumerate(carry)))


def tamper_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row of documents, where every row
    whose crc32 of doc_id is divisible by 7 has been given one more in n_chars since the manifest was made."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    fields = [F.col(c) for c in ("doc_id", "source", "lang")]
    now = F.when(tampered, leaf_digest(*fields, F.col("n_chars") + 1, F.col("text")))
    made = manifest(docs, now=now)
    made = made.withColumn("folded_root", folded(F.coalesce("now", "leaf"), F.col("proof")))
    return made.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
