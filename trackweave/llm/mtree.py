"""Exact top-k by inner product through M-trees.

With one more component, sqrt(M - |x|^2) where M is the largest squared length, all vectors lie on a sphere, and the
largest inner product with a query is the least distance. Distinct vectors are dealt to pivots, and a pivot's vectors
to trees of bounded size. A tree is stored as pages: a page has up to PAGE entries, each with its covering radius, its
distance to the page's own routing object, and its child page or vector ids. A query walks a tree best-first; an
entry's distance is computed only if the stored distances and the triangle inequality leave it a chance.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, salted_join

#: Vectors of a tree, entries of a page, routing objects of an inner page, queries that a task takes through a tree.
TREE, PAGE, FANOUT, BLOCK = 8192, 256, 16, 2048
#: Vectors to route by, the sample the index is fitted on: those with the least hashes, four for each tree but within
#: these bounds (at most 4,096 vectors reach the driver and the tasks). Beyond them a pivot has several trees.
PIVOTS, MOST_PIVOTS = 64, 4096
SCALE = 256
#: Sums of products are exact in floating point below this.
EXACT = 1 << 53
#: Distances are floating-point: bounds are loosened by this part before anything is left out.
SLACK = 1e-9


def integer_vectors(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, v, norm): floor(256 * x) of each component as little-endian int64, and the sum of squares.

    Left out: null vectors or ids, vectors with null or non-finite components, empty vectors. A sum of squares of EXACT
    or more fails: scores would not be exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            offsets, values = column.offsets.to_numpy(), column.values
            known = np.asarray(values.is_valid())
            x = values.to_numpy(zero_copy_only=False).astype(np.float64) if len(values) else np.zeros(0)
            fine = known & np.isfinite(x)
            whole = np.floor(SCALE * np.where(fine, x, 0))
            whole = np.where(np.abs(whole) < EXACT, whole, EXACT).astype("<i8")
            valid = np.asarray(column.is_valid()) & np.asarray(ids.is_valid())
            keep, vs, norms = [], [], []
            for i in np.flatnonzero(valid).tolist():
                a, b = int(offsets[i]), int(offsets[i + 1])
                if b > a and fine[a:b].all():
                    keep.append(i)
                    vs.append(whole[a:b].tobytes())
                    norms.append(float(whole[a:b].astype(np.float64) @ whole[a:b].astype(np.float64)))
                    if norms[-1] >= EXACT:
                        raise ValueError(f"components too large for exact scores: {ids[i]}")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(vs, pa.binary()), pa.array([int(n) for n in norms], pa.int64())], names=["id", "v", "norm"])

    kind = rows.schema[ident].dataType.simpleString()
    return rows.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"id {kind}, v binary, norm long")


def matrix(values, largest: float) -> np.ndarray:
    """The vectors as rows, with the component that puts them on the sphere."""
    x = np.stack([np.frombuffer(v, "<i8") for v in values]).astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0))))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def build(x: np.ndarray) -> list[dict]:
    """Pages of a tree over the rows of x; page 0 is the root, entries of leaves name rows.

    A page: leaf, entries (routing objects or vectors), radius, parent (distances to the page's routing object; 0 in
    the root) and child (page or row numbers)."""
    pages: list[dict | None] = [None]
    waiting = [(0, np.arange(len(x)), None)]
    while waiting:
        number, rows, routing = waiting.pop()
        if len(rows) <= PAGE:
            parent = np.zeros(len(rows)) if routing is None else distances(x[rows], routing[None])[:, 0]
            pages[number] = {"leaf": True, "entries": x[rows], "radius": np.zeros(len(rows)), "parent": parent, "child": rows}
            continue
        some = rows[:: max(1, len(rows) // 512)]
        near = distances(x[some], x[some[:1]])[:, 0]
        seeds = [int(some[0])]
        for _ in range(min(FANOUT, -(-len(rows) // (PAGE // 2))) - 1):  # each the farthest from those before
            seeds.append(int(some[int(near.argmax())]))
            near = np.minimum(near, distances(x[some], x[seeds[-1:]])[:, 0])
        seeds = list(dict.fromkeys(seeds))
        d = distances(x[rows], x[seeds])
        nearest = d.argmin(1)
        if len(seeds) < 2 or np.bincount(nearest).max() > 0.9 * len(rows):  # no good split: by distance from one of them
            seeds = seeds[:1] * 4
            nearest = np.empty(len(rows), np.int64)
            nearest[d[:, 0].argsort(kind="stable")] = np.arange(len(rows)) * 4 // len(rows)
            d = np.repeat(d[:, :1], 4, 1)
        children, radius, used = [], [], []
        for k, seed in enumerate(seeds):
            own = nearest == k
            if own.any():
                children.append(len(pages))
                radius.append(d[own, k].max())
                used.append(seed)
                waiting.append((len(pages), rows[own], x[seed]))
                pages.append(None)
        parent = np.zeros(len(used)) if routing is None else distances(x[used], routing[None])[:, 0]
        pages[number] = {"leaf": False, "entries": x[used], "radius": np.array(radius), "parent": parent, "child": np.array(children)}
    return pages


def search(pages: dict[int, dict], q: np.ndarray, k: int, least: float, total: float) -> list[tuple[float, int]]:
    """The k best (inner product, row) of a tree for q, and all that tie with the last; none below ``least``.

    total is |q|^2 + M, so an inner product s and a distance d belong together by d^2 = total - 2 s."""
    best: list[tuple[float, int]] = []
    scores: list[float] = []  # heap of the k best
    bound = least
    reach = np.sqrt(max(total - 2 * bound, 0)) * (1 + SLACK) + SLACK if bound > -np.inf else np.inf
    waiting: list[tuple[float, int, float | None]] = [(0.0, 0, None)]
    while waiting:
        lower, number, to_parent = heapq.heappop(waiting)
        if lower > reach:
            break
        page = pages[number]
        rows = slice(None)
        if to_parent is not None and reach < np.inf:
            rows = np.flatnonzero(np.abs(to_parent - page["parent"]) - page["radius"] <= reach)
            if not len(rows):
                continue
        products = page["entries"][rows] @ q
        child = page["child"][rows]
        if page["leaf"]:
            good = np.flatnonzero(products >= bound)
            for s, c in zip(products[good].tolist(), child[good].tolist(), strict=True):
                if s >= bound:
                    best.append((s, c))
                    if len(scores) < k:
                        heapq.heappush(scores, s)
                    else:
                        heapq.heappushpop(scores, s)
                    if len(scores) == k and scores[0] > bound:
                        bound = scores[0]
                        reach = np.sqrt(max(total - 2 * bound, 0)) * (1 + SLACK) + SLACK
        else:
            d = np.sqrt(np.maximum(total - 2 * products, 0))
            lower = np.maximum(d - page["radius"][rows], 0) * (1 - SLACK)
            for k_ in np.flatnonzero(lower <= reach).tolist():
                heapq.heappush(waiting, (float(lower[k_]), int(child[k_]), float(d[k_])))
    return [b for b in best if b[0] >= bound]


PAGES = "tree string, page int, leaf boolean, entries binary, radius binary, parent binary, child binary, ids array<array<{id}>>"


def index(vectors: DataFrame, largest: float, pivots: np.ndarray) -> tuple[DataFrame, dict[int, float], dict[int, int]]:
    """The pages of all trees, the covering radius of each pivot's vectors, and how many trees it has.

    vectors: (v, ids). Every vector is in one tree; a pivot with many has several trees, dealt by the vector's hash."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(matrix(batch.column(0).to_pylist(), largest), pivots)
                nearest = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(d)), nearest])], names=[*batch.schema.names, "pivot", "far"])

    kind = vectors.schema["ids"].dataType.elementType.simpleString()
    dealt = materialize(vectors.mapInArrow(assign, f"v binary, ids array<{kind}>, pivot int, far double"), "vectors")
    held = dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # PIVOTS rows at most
    trees = {r["pivot"]: -(-r["n"] // TREE) for r in held}
    many = F.element_at(F.array(*(F.lit(trees.get(p, 1)) for p in range(len(pivots)))), F.col("pivot") + 1)
    name = F.concat_ws("-", "pivot", F.pmod(F.xxhash64("v"), many))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        x = matrix(pdf["v"], largest)
        ids = [list(i) for i in pdf["ids"]]
        rows = []
        for number, page in enumerate(build(x)):
            rows.append((pdf["tree"].iloc[0], number, page["leaf"], page["entries"].tobytes(), page["radius"].tobytes(), page["parent"].tobytes(), page["child"].astype("<i8").tobytes(), [ids[c] for c in page["child"]] if page["leaf"] else []))
        return pd.DataFrame(rows, columns=["tree", "page", "leaf", "entries", "radius", "parent", "child", "ids"])

    pages = dealt.select(name.alias("tree"), "v", "ids").groupBy("tree").applyInPandas(plant, PAGES.format(id=kind))
    return materialize(pages, "mtree-pages"), {r["pivot"]: r["far"] for r in held}, trees


def _walk(pages: DataFrame, asked: DataFrame, k: int, largest: float) -> DataFrame:
    """(v, score, ids): what each asked (v, least, tree) finds in its tree. A tree's queries are dealt to as many
    blocks as they need, and its pages go to these alone."""
    kind = pages.schema["ids"].dataType.elementType.elementType.simpleString()

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tree, ids = {}, {}
        for row in left.itertuples():
            n = len(row.radius) // 8
            of = lambda b: np.frombuffer(b, "<f8")
            child = np.frombuffer(row.child, "<i8")
            tree[row.page] = {"leaf": row.leaf, "entries": of(row.entries).reshape(n, -1), "radius": of(row.radius), "parent": of(row.parent), "child": child}
            if row.leaf:
                ids.update(zip(child.tolist(), row.ids, strict=True))
        out = []
        if tree:
            for v, least in zip(right["v"], right["least"], strict=True):
                x = np.frombuffer(v, "<i8").astype(np.float64)
                found = search(tree, np.append(x, 0.0), k, -np.inf if least is None or np.isnan(least) else least, float(x @ x) + largest)
                out.extend((v, int(round(s)), list(ids[row])) for s, row in found)
        return pd.DataFrame(out, columns=["v", "score", "ids"])

    asked = materialize(asked, "mtree-asked")
    blocks = asked.groupBy("tree").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    left = salted_join(pages, blocks, ["tree"], by=F.col("page")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = salted_join(asked, blocks, ["tree"], by=F.col("v")).withColumn("block", F.pmod(F.xxhash64("v", F.lit(7)), F.col("blocks")).cast("int")).drop("blocks")
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInPandas(run, f"v binary, score long, ids array<{kind}>")


def top_k(rows: DataFrame, queries, k: int = 5, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the largest inner product for each query row.

    queries: a condition on ident that says which rows ask. Candidates are all rows but the query's own; ties go to the
    smaller id; fewer than k others: all of them. Vectors (null, empty, with null or non-finite components) and rows
    (null id) that can't be compared take no part, nor do vectors of another length than most have (of equally common
    ones the shorter). Rows that repeat are candidates each and ask each. Components so large that scores can't be
    exact (sums of squares of 2**53) fail the job. Empty table: no rows. Other columns play no part.
    """
    spark = rows.sparkSession
    kind = rows.schema[ident].dataType.simpleString()
    every = materialize(integer_vectors(rows, ident, vector), "integer-vectors")
    usual = every.groupBy(F.length("v").alias("n")).agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("many"), "n").first()
    if usual is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    every = every.where(F.length("v") == usual["n"])
    # Of equal vectors only the k + 1 least ids can be among k answers, one of them being the query's own.
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    vectors = materialize(every.select("v", "id", rank.alias("r")).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "mtree-vectors")
    largest = float(every.agg(F.max("norm")).first()[0])
    most = min(MOST_PIVOTS, max(PIVOTS, 4 * vectors.count() // TREE))
    sample = [r["v"] for r in vectors.orderBy(F.xxhash64("v"), "v").limit(most).select("v").collect()]
    pivots = matrix(sample, largest)
    pages, far, trees = index(vectors, largest, pivots)
    asking = every.withColumnRenamed("id", ident).where(queries).select(F.col(ident).alias("id"), "v", "norm")
    asking = materialize(asking, "queries")
    distinct = asking.select("v").distinct()

    def ask(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vs = batch.column(0).to_pylist()
                if not vs:
                    continue
                least = [None] * len(vs) if first else batch.column(1).to_pylist()
                x = np.stack([np.frombuffer(v, "<i8") for v in vs]).astype(np.float64)
                total = (x * x).sum(1) + largest
                d = np.sqrt(np.maximum(total[:, None] - 2 * (np.column_stack((x, np.zeros(len(x)))) @ pivots.T), 0))
                out = []
                for i, v in enumerate(vs):
                    if first:
                        p = min(trees, key=lambda p: d[i, p])
                        out.append((v, None, f"{p}-{zlib.crc32(v) % trees[p]}"))
                        continue
                    reach = np.inf if least[i] is None else np.sqrt(max(total[i] - 2 * least[i], 0)) * (1 + SLACK) + SLACK
                    out.extend((v, least[i], f"{p}-{t}") for p in trees if d[i, p] - far[p] * (1 + SLACK) <= reach for t in range(trees[p]))
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.string())], names=["v", "least", "tree"])

        return run

    shape = "v binary, least double, tree string"
    # One tree of the nearest pivot tells how good the k-th answer is at least; then all trees that can have a better one.
    first = _walk(pages, distinct.mapInArrow(ask(True), shape), k + 1, largest)
    listed = first.select("v", "score", F.explode("ids").alias("id"))
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), "id"))
    bound = listed.select("v", "score", place.alias("r")).where(F.col("r") == k + 1).select("v", F.col("score").cast("double").alias("least"))
    asked = distinct.join(bound, "v", "left")
    found = _walk(pages, asked.mapInArrow(ask(False), shape), k + 1, largest)
    answers = found.select("v", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), "vec_id"))
    answers = materialize(answers.select("v", "score", "vec_id", place.alias("r")).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("a")), "answers")
    each = salted_join(asking, answers, ["v"], by=F.col("id"))
    # The query's own row is one of those with its id and with its vector's score; rows that repeat tie in both.
    mine = F.array_position(F.transform("a", lambda a: (a["vec_id"] == F.col("id")) & (a["score"] == F.col("norm"))), True)
    own = F.slice(F.filter("a", lambda a, i: i + 1 != mine), 1, k)
    out = each.select(F.col("id").alias("query_id"), F.posexplode(own).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
