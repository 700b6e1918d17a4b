"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two values that differ in at most two bits have a common neighbour at one bit from each. So every fingerprint emits
itself and all values at one bit from it (half the radius); values that meet are shuffled together, deduplicated and
verified. All that meet in one value are within the radius of each other, so a link from each to the least of them
says as much as all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, salted_join
from trackweave.llm.components import components

#: Bits by which fingerprints of one group may differ; half of it is emitted.
RADIUS = 2
#: The contract's seed of XXH64.
SEED = 42


def shingle_hashes(data: bytes, size: int):
    """XXH64 of each shingle of size words (fewer words: the whole sequence; none: no shingle), repeats included."""
    import numpy as np
    import xxhash
    from itertools import repeat

    words = data.lower().split()
    if len(words) <= size:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def majority_bits(hashes: list, lanes: int = 1):
    """Rows of ``lanes`` uint64: bit b of a row is 1 if it is set in over half of that text's hashes.

    Lane 0 takes the hashes themselves, further lanes a mixed form. Counts are kept four to a word, 16 bits each.
    """
    import numpy as np

    n = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros((len(n), lanes), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    every = np.concatenate([hashes[i] for i in full])
    spread = np.array([sum(1 << 16 * j for j in range(4) if v >> j & 1) for v in range(16)], np.uint64)
    ends = np.cumsum(n[full])
    begins = ends - n[full]
    cuts = [np.arange(b, e, 65535) for b, e in zip(begins, ends, strict=True)]
    heads = np.concatenate(([0], np.cumsum([len(c) for c in cuts])[:-1]))
    cuts = np.concatenate(cuts)
    for lane in range(lanes):
        h = every
        if lane:
            with np.errstate(over="ignore"):
                h = every + np.uint64(0x9E3779B97F4A7C15 * lane & (1 << 64) - 1)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(31)
        value = np.zeros(len(full), np.uint64)
        for nibble in range(16):
            counted = np.add.reduceat(spread[(h >> np.uint64(4 * nibble)) & np.uint64(15)], cuts).view(np.uint16).reshape(-1, 4).astype(np.int64)
            counted = np.add.reduceat(counted, heads, axis=0)
            for j in range(4):
                value |= (2 * counted[:, j] > n[full]).astype(np.uint64) << np.uint64(4 * nibble + j)
        out[full, lane] = value
    return out


def fingerprints(docs: DataFrame, ident: str, text: str, size: int, lanes: int = 1, **carry: Column) -> DataFrame:
    """(id, the columns in carry, f0, f1, ...): the fingerprint of every text as ``lanes`` longs; no words: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            hashes = [shingle_hashes(v.as_py() or b"", size) for v in values]
            bits = majority_bits(hashes, lanes).view("int64")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(bits[:, k]) for k in range(lanes))], names=names)

    given = docs.select(F.col(ident).alias("id"), *(c.alias(k) for k, c in carry.items()), F.col(text).alias("text"))
    names = [*given.columns[:-1], *(f"f{k}" for k in range(lanes))]
    kinds = [f.dataType.simpleString() for f in given.schema[:-1]] + ["long"] * lanes
    return given.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def ball(value: Column, bits: int) -> Column:
    """Array of the value and of all values at one bit from it."""
    masks = [0, *(1 << b if b < 63 else -(1 << 63) for b in range(bits))]
    return F.array(*(value.bitwiseXOR(F.lit(m).cast("long")) for m in masks))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) for the distinct fingerprints fp: from each to the least of those it meets, verified."""
    emitted = distinct.select("fp", F.explode(ball(F.col("fp"), 64)).alias("variant"))
    met = emitted.withColumn("least", F.min("fp").over(Window.partitionBy("variant"))).where("fp != least")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= RADIUS).groupBy(F.col("least").alias("a"), F.col("fp").alias("b")).agg(F.lit(1).alias("one")).select("a", "b")


def simhash_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """A row for each row of ``docs``: ident, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints link at RADIUS or fewer differing bits; component_id is the least id that can be reached. A-Z are
    lower-cased, words are what white space (space, bytes 9 to 13) separates.

    Null or empty text, or white space alone: fingerprint zero, linked like any other. Fewer words than ``size``: one
    shingle. Null id: a row with its fingerprint; it stands for nothing as component_id unless its whole component
    has null ids, which then is null. Rows that repeat: a result each. Empty table: no rows.
    """
    marked = materialize(fingerprints(docs, ident, text, size).withColumnRenamed("f0", "fp"), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    labels = components(links(distinct))
    grouped = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    grouped = grouped.where("n > 1").select("fp", "label", "least").union(labels.join(distinct, labels["node"] == distinct["fp"]).where("n = 1").select("fp", "label", "least"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    chosen = salted_join(grouped.select("fp", "label"), least, ["label"], by=F.col("fp")).select("fp", "component_id", F.lit(True).alias("shared"))
    out = salted_join(marked, chosen, ["fp"], "left", by=F.col("id"))
    return out.select(F.col("id").alias(ident), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


#: For near_dedup: shingles of the fingerprint and of the similarity, lanes of 64 bits, and the least similarity.
BLOCK_SHINGLE, SHINGLE, LANES, SIMILARITY = 3, 5, 4, 0.8


def ball_links(marked: DataFrame) -> DataFrame:
    """(a, b), a < b: the links of simhash_groups between the texts of ``marked`` (id, f0, ...), by their first lane: every
    text and the least one of its fingerprint, and the least ones of fingerprints that meet within RADIUS."""
    own = marked.select("id", F.col("f0").alias("fp"))
    first = materialize(own.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "near-balls")
    same = salted_join(own, first.where("n > 1").drop("n"), ["fp"], by=F.col("id")).where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    end = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}"))
    met = links(first.select("fp")).join(end("a"), "a").join(end("b"), "b")
    return same.union(met.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))


def near_groups(docs: DataFrame, marked: DataFrame, ident: str, text: str, lanes: int = LANES, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label): ids of different texts that links join, and the least id each reaches. A link joins texts whose
    sets of SHINGLE-word shingles have a Jaccard similarity of ``similarity``.

    marked: a row for each text, (id, k, t0, t1, n) as _rows_of wants them and its fingerprint, which has 64 * lanes
    bits, in blocks of 32.

    First every text that SimHash links is compared with the least one that it links it to (``ball_links``), any other
    with one that has most blocks in common with it, of those that are the least of a block; so a large group of copies
    is joined by one comparison for each. What that leaves is found exactly: texts
    that are similar enough share a shingle among the rarest of both (``rare_shingles``). In rounds, each text that
    shares one with a text of another group meets one partner from another group, that with which it shares most of
    them, and links join groups. When few of a round's pairs are links, the texts of different groups that share a
    rare shingle and have not met are compared, all with all.
    """
    low, high = (lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda c: F.shiftrightunsigned(c, 32))
    blocks = [part(F.col(f"f{k}")) for k in range(lanes) for part in (low, high)]
    keyed = F.array(*(b.bitwiseOR(F.lit(i << 32).cast("long")) for i, b in enumerate(blocks)))
    given = marked.select("id", F.explode(keyed).alias("block"))
    first = given.groupBy("block").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("block", "least")
    shared = salted_join(given, first, ["block"], by=F.col("id")).where("id != least").select("id", F.col("least").alias("other"))
    linked = ball_links(marked)
    linked = materialize(linked.select(F.col("a").alias("id"), F.col("b").alias("other")).union(linked.select("b", "a")).groupBy("id").agg(F.min("other").alias("other")), "near-linked")
    others = _best_partners(shared.join(linked.select("id"), "id", "left_anti"))
    tried = materialize(linked.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).union(others).distinct(), "near-tried")
    found = materialize(_alike(tried, docs, marked, ident, text, similarity), "near-equal-blocks")
    rare = rare_shingles(docs, marked, ident, text, similarity)
    shared = rare.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    rare = materialize(salted_join(rare, shared, ["gram"], "left_semi", by=F.col("id")), "near-shared")
    own = _in_several_groups(rare, components(found))
    while True:
        # Of each shingle a text of the least group and one of the greatest; every text is in another group than one.
        ends = own.groupBy("gram").agg(*(f(F.struct("label", "id", "size", "at")).alias(n) for n, f in (("_lo", F.min), ("_hi", F.max))))
        met = salted_join(own, ends, ["gram"], by=F.col("id"))
        met = met.withColumn("_x", F.when(F.col("label") == F.col("_lo.label"), F.col("_hi")).otherwise(F.col("_lo"))).select("id", "label", "size", "at", *(F.col(f"_x.{c}").alias(f"_{c}") for c in ("id", "label", "size", "at")))
        pairs = _best_partners(met.where(_may_reach(similarity)).select("id", F.col("_id").alias("other")), tried)
        more = materialize(_alike(pairs, docs, marked, ident, text, similarity), "near-links")
        n_pairs, n_links = pairs.count(), more.count()
        found, tried = found.union(more), tried.union(pairs)
        if n_links:
            own = _joined_groups(own, more)
        if n_links * ROUND_LINKS < n_pairs or not n_links:
            break
    other = own.select("gram", *(F.col(c).alias(f"_{c}") for c in ("id", "label", "size", "at")))
    left = own.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int"))
    right = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    met = left.join(right, (left["gram"] == right["gram"]) & (left["_salt"] == right["_salt"]) & (F.col("_id") < F.col("id")) & _may_reach(similarity))
    rest = met.select(F.col("_id").alias("a"), F.col("id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = _alike(materialize(rest, "near-rest"), docs, marked, ident, text, similarity)
    return components(materialize(found.union(more), "near-links"))


#: Rounds of one partner a text go on while at least one pair in so many is a link.
ROUND_LINKS = 5


def _best_partners(met: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: for each text of (id, other) the other that it meets most often, of equals the least, unless the
    pair is among those tried."""
    counted = met.groupBy("id", "other").agg(F.count(F.lit(1)).alias("n")).select("id", "other", "n", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    if tried is not None:
        counted = counted.join(tried, ["a", "b"], "left_anti")
    best = counted.groupBy("id").agg(F.max(F.struct("n", -F.col("other"), "a", "b")).alias("x"))
    return materialize(best.select("x.a", "x.b").distinct(), "near-pairs")


def _in_several_groups(rare: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of rare shingles with the label of their text, where a shingle is in texts of several labels."""
    own = rare.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    return _shared(materialize(own, "near-labelled"))


def _shared(own: DataFrame) -> DataFrame:
    several = own.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("gram")
    return materialize(salted_join(own, several, ["gram"], "left_semi", by=F.col("id")), "near-several")


def _joined_groups(own: DataFrame, links: DataFrame) -> DataFrame:
    """The rows that are left when links (a, b) between their texts have joined groups; only the labels that links join
    are labelled anew. A shingle of one group stays one of one group, so rows only get fewer."""
    of = own.select("id", "label").distinct()
    ends = links.join(of.select(F.col("id").alias("a"), F.col("label").alias("_a")), "a").join(of.select(F.col("id").alias("b"), F.col("label").alias("_b")), "b")
    new = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("_new"))
    named = salted_join(own, new, ["label"], "left", by=F.col("id")).withColumn("label", F.coalesce("_new", "label")).select(*own.columns)
    return _shared(materialize(named, "near-labelled"))


def _may_reach(similarity: float) -> Column:
    """Texts of different groups that can be similar enough if this is the first shingle, in order, that they share."""
    most = F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at"))
    return (F.col("label") != F.col("_label")) & (most * (1 + similarity) >= similarity * (F.col("size") + F.col("_size")) - 1e-6)


#: Shingles of a block of texts, texts of it at most, shingles that are counted together, and the most such parts.
BLOCK_SHINGLES, BLOCK_TEXTS, PART_SHINGLES, PARTS = 2_000_000, 65_535, 1_000_000, 65_536


def rare_shingles(docs: DataFrame, marked: DataFrame, ident: str, text: str, similarity: float) -> DataFrame:
    """(id, gram, size, at): of each text of ``marked`` the shingles of its prefix that other texts have as well.

    A text's distinct shingles are ordered by how many texts have them, then by hash; size is their number, at a
    shingle's place. Two texts with a Jaccard similarity of ``similarity`` share a shingle among the first
    size - ceil(similarity * size) + 1 of each. Shingles are 40 bits of hash; those of one text alone go out.

    Blocks of texts deal their shingles by hash into parts, parts count, and what several texts have goes back to its
    block; a shingle takes seven bytes on the way. A block's name is a hash of its texts in order.
    """
    kind = "bigint"
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    parts = int(min(PARTS, max(16, chars // (6 * PART_SHINGLES))))
    # In one order, so that a task that is repeated gives its blocks the same names.
    wanted = _rows_of(docs, marked, ident, text).sortWithinPartitions("id")
    names = ["part", "block", "grams", "which", "ids", "sizes"]
    schema = f"part int, block long, grams binary, which binary, ids array<{kind}>, sizes array<int>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        sets: list = []
        ids: list[pa.Array] = []
        content = xxhash.xxh3_64()
        held = 0

        def block() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(s) for s in sets], np.int32)
            grams, which = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            part = (grams % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            grams, which, part = grams[order], which[order], part[order]
            has, begins = np.unique(part, return_index=True)
            stops = np.append(begins[1:], len(part))
            name = content.intdigest() - (1 << 63)
            five = np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
            n = len(has)
            flat = pa.concat_arrays(ids)
            one = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
            counted = pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.array(sizes))
            yield pa.RecordBatch.from_arrays([pa.array([name % parts], pa.int32()), pa.array([name], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), one, counted], names=names)
            for i in range(0, n, 1000):
                j = min(n, i + 1000)
                yield pa.RecordBatch.from_arrays([
                    pa.array(has[i:j], pa.int32()), pa.array([name] * (j - i), pa.int64()),
                    pa.array([five[begins[k]:stops[k]].tobytes() for k in range(i, j)], pa.binary()), pa.array([which[begins[k]:stops[k]].tobytes() for k in range(i, j)], pa.binary()),
                    pa.nulls(j - i, one.type), pa.nulls(j - i, counted.type),
                ], names=names)

        for batch in batches:
            for k, v in enumerate(batch.column(3).cast(pa.large_binary())):
                sets.append(np.unique(shingle_hashes(v.as_py() or b"", SHINGLE) >> np.uint64(24)))
                ids.append(batch.column(0).slice(k, 1))
                content.update(f"{batch.column(1)[k]} {batch.column(2)[k]} ".encode())
                held += len(sets[-1])
                if held >= BLOCK_SHINGLES or len(sets) == BLOCK_TEXTS:
                    yield from block()
                    sets, ids, content, held = [], [], xxhash.xxh3_64(), 0
        if sets:
            yield from block()

    def count(key, rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        counted = rows[rows["grams"].notna()]
        out = [rows[rows["grams"].isna()].assign(counts=None)[["block", "grams", "which", "counts", "ids", "sizes"]]]
        if len(counted):
            five = np.frombuffer(b"".join(counted["grams"]), np.uint8).reshape(-1, 5)
            grams = np.zeros((len(five), 8), np.uint8)
            grams[:, :5] = five
            grams = grams.view("<u8").ravel()
            which = np.frombuffer(b"".join(counted["which"]), np.uint16)
            _, at, n = np.unique(grams, return_inverse=True, return_counts=True)
            n = n[at].astype(np.uint32)
            ends = np.cumsum([len(w) // 2 for w in counted["which"]])
            several = n > 1
            for i, name in enumerate(counted["block"]):
                mine = slice(ends[i - 1] if i else 0, ends[i])
                if several[mine].any():
                    m = several[mine]
                    out.append(pd.DataFrame({"block": [name], "grams": [grams[mine][m].tobytes()], "which": [which[mine][m].tobytes()], "counts": [n[mine][m].tobytes()], "ids": [None], "sizes": [None]}))
        return pd.concat(out)

    def prefixes(key, rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        texts, found = rows[rows["ids"].notna()], rows[rows["grams"].notna()]
        none = pd.DataFrame({"id": [], "gram": [], "size": [], "at": []})
        if not len(found):
            return none
        if not len(texts):
            raise ValueError("the texts have come in another order than before; write them to a table first")
        ids, sizes = list(texts["ids"].iloc[0]), np.asarray(texts["sizes"].iloc[0], np.int64)
        grams, which, counts = (np.frombuffer(b"".join(found[c]), t) for c, t in (("grams", np.int64), ("which", np.uint16), ("counts", np.uint32)))
        order = np.lexsort((grams, counts, which))
        grams, which = grams[order], which[order].astype(np.int64)
        if len(texts) > 1:  # equal blocks
            new = np.append(True, (grams[1:] != grams[:-1]) | (which[1:] != which[:-1]))
            grams, which = grams[new], which[new]
        shared = np.bincount(which, minlength=len(sizes))
        # Behind the shingles that the text has alone.
        at = sizes[which] - shared[which] + np.arange(len(which)) - (np.cumsum(shared) - shared)[which]
        keep = at <= sizes[which] - np.ceil(similarity * sizes[which] - 1e-9)
        return pd.DataFrame({"id": np.array(ids, np.int64)[which[keep]], "gram": grams[keep], "size": sizes[which[keep]], "at": at[keep]})

    dealt = wanted.mapInArrow(deal, schema)
    counted = dealt.groupBy("part").applyInPandas(count, f"block long, grams binary, which binary, counts binary, ids array<{kind}>, sizes array<int>")
    out = counted.groupBy("block").applyInPandas(prefixes, f"id {kind}, gram long, size int, at int")
    return materialize(out, "near-rare")


def _alike(pairs: DataFrame, docs: DataFrame, marked: DataFrame, ident: str, text: str, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of ids, which are written, whose texts are similar enough."""
    sides = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(marked.select("id", "k", "t0", "t1", "n"), "id")
    sets = materialize(_shingle_sets(_rows_of(docs, sides, ident, text), "id", "text"), "near-shingles")
    left = salted_join(pairs, sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), ["a"], by=F.col("b"), salts=4)
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.where(_jaccard(F.col("sa"), F.col("sb")) >= similarity).select("a", "b")


def _content(text: str) -> list[Column]:
    """__tw_t0 and __tw_t1: 96 bits of hash that stand for a text; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("__tw_t0"), F.hash(whole).alias("__tw_t1")]


def _name(ident: Column) -> Column:
    """An id as text, null as well."""
    return F.coalesce(F.concat(F.lit("i"), ident.cast("string")), F.lit("n"))


#: Node numbers from here on are made of hashes.
HASHED = 1 << 62


def _node_numbers(nodes: DataFrame) -> DataFrame:
    """``nodes`` (own, t0, ...) with id, a long for each text: its ident if that is a whole number below HASHED and of
    no other text with a smaller hash, so that small idents stay small; else HASHED and 62 bits of the text's hash. Of
    texts that have one number, less than one pair in 10**9 texts, one is left."""
    hashed = F.shiftrightunsigned("t0", 2).bitwiseOR(F.lit(HASHED).cast("long"))
    names = nodes.columns
    if nodes.schema["own"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        return nodes.withColumn("id", hashed).dropDuplicates(["id"])
    known = nodes.where("own is not null").groupBy("own").agg(F.count(F.lit(1)).alias("_many"), F.min("t0").alias("_first")).where("_many > 1")
    plain = F.col("own").isNotNull() & (F.col("own") < HASHED)
    if known.isEmpty():
        given = nodes.withColumn("id", F.when(plain, F.col("own").cast("long")).otherwise(hashed))
    else:
        some = salted_join(nodes.where("own is not null"), known, ["own"], "left", by=F.col("t0")).unionByName(nodes.where("own is null"), allowMissingColumns=True)
        given = some.withColumn("id", F.when(plain & F.coalesce(F.col("t0") == F.col("_first"), F.lit(True)), F.col("own").cast("long")).otherwise(hashed))
    rest = [c for c in names if c != "id"]
    return given.groupBy("id").agg(F.min(F.struct(*rest)).alias("x")).select("id", "x.*")


def _rows_of(docs: DataFrame, nodes: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, t0, t1, text): for each of nodes (id, k, t0, t1, n) its text, from the row of ``docs`` that has its ident
    (k, by name) and hashes; of the n rows that have them, one."""
    keys = ["__tw_k", "__tw_t0", "__tw_t1"]
    given = docs.select(_name(F.col(ident)).alias("__tw_k"), *_content(text), F.col(text).alias("text"))
    own = nodes.select(F.col("k").alias("__tw_k"), F.col("t0").alias("__tw_t0"), F.col("t1").alias("__tw_t1"), "id", "n")
    found = given.join(own.hint("shuffle_hash"), keys).select("id", F.col("__tw_t0").alias("t0"), F.col("__tw_t1").alias("t1"), "text")
    return found if nodes.where("n > 1").isEmpty() else found.dropDuplicates(["id"])


def _shingle_sets(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, shingles): the upper halves of the distinct hashes of each text's shingles, sorted, as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            sets = [np.unique((shingle_hashes(v.as_py() or b"", SHINGLE) >> np.uint64(32)).astype(np.uint32)).tobytes() for v in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {docs.schema[ident].dataType.simpleString()}, shingles binary")


def _jaccard(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
        import numpy as np

        def one(x: bytes, y: bytes) -> float:
            p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            shared = len(np.intersect1d(p, q, assume_unique=True))
            return shared / max(1, len(p) + len(q) - shared)

        return pd.Series([one(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return similarity(a, b)


def near_dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of equal or near texts: that with the least ident.

    Equal texts (null as empty) are one group. Different texts belong together if links of near_groups join them.
    Texts without words are near to their equals alone. Texts are told apart by 96 bits of hash and compared whatever
    their idents are: null ones come last, of texts with one ident that with the least hash comes first. Of rows that
    repeat both ident and text one stays. Empty table: no rows. Columns pass as they are.
    """
    t0, t1 = _content(text)
    marked = materialize(fingerprints(docs, ident, text, BLOCK_SHINGLE, LANES, t0=t0, t1=t1), "near-fingerprints")
    lanes = [f"f{k}" for k in range(LANES)]
    rows = marked.groupBy("t0", "t1", "id").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in lanes))
    texts = rows.groupBy("t0", "t1").agg(F.min(F.struct(F.col("id").isNull(), "id", "n", *lanes)).alias("x"))
    texts = materialize(texts.select("t0", "t1", "x.id", _name(F.col("x.id")).alias("k"), "x.n", *(f"x.{c}" for c in lanes)), "near-texts")
    # Texts without words have the fingerprint zero in every lane; nothing else practically has.
    nodes = texts.where("not (" + " and ".join(f"{c} = 0" for c in lanes) + ")").withColumnRenamed("id", "own")
    nodes = materialize(_node_numbers(nodes), "near-nodes")
    labels = near_groups(docs, nodes, ident, text, similarity=similarity)
    members = materialize(labels.join(nodes.select(F.col("id").alias("node"), "t0", "t1", "own"), "node"), "near-members")
    order = F.struct(F.col("own").isNull(), "own", "t0", "node")
    first = members.groupBy("label").agg(F.min(order).alias("_first"))
    gone = salted_join(members, first, ["label"], by=F.col("node")).where(F.col("node") != F.col("_first.node")).select("t0", "t1")
    kept = texts.join(gone, ["t0", "t1"], "left_anti")
    keys = ["__tw_t0", "__tw_t1", "__tw_k"]
    kept = materialize(kept.select(F.col("t0").alias("__tw_t0"), F.col("t1").alias("__tw_t1"), F.col("k").alias("__tw_k"), "n"), "near-kept")
    stays = docs.withColumns(dict(zip(keys, (*_content(text), _name(F.col(ident))), strict=True))).join(kept.drop("n").hint("shuffle_hash"), keys, "left_semi")
    if not kept.where("n > 1").isEmpty():
        stays = stays.dropDuplicates(keys)
    return stays.select(*docs.columns)
