"""Small networks over array columns: dense layers as matrix products of Arrow batches, encoders, heads, message rounds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.operators.lineage import _written
from trackweave.operators.vectors import messages

SEQ = "sequence_id"


@dataclass(frozen=True)
class Dense:
    """x @ weights.T + bias, then layer normalisation (scale, shift) if there is one, then relu if wanted."""

    weights: np.ndarray
    bias: np.ndarray
    norm: tuple[np.ndarray, np.ndarray] | None = None
    relu: bool = True
    eps: float = 1e-5

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.weights.T + self.bias
        if self.norm:
            y = (y - y.mean(1, keepdims=True)) / np.sqrt(y.var(1, keepdims=True) + self.eps) * self.norm[0] + self.norm[1]
        return np.maximum(y, 0) if self.relu else y


Mlp = tuple[Dense, ...]


def encoded(column: Column, mlp: Mlp) -> Column:
    """The array column through the layers; a batch is one product a layer. Null stays null; the wrong length is an error."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        there = values.notna().to_numpy()
        if not there.any():
            return pd.Series([None] * len(values), dtype=object)
        x = np.stack([np.asarray(v, np.float64) for v in values[there]])
        for layer in mlp:
            x = layer(x)
        rows = iter(x)
        return pd.Series([next(rows) if known else None for known in there], dtype=object)

    return run(column) if mlp else column.cast("array<double>")


def fused(nodes: DataFrame, handcrafted: str | None, deep: str | None, mode: str = "concat", encoders: tuple[Mlp, Mlp] = ((), ()), fusion: Mlp = (), out: str = "features") -> DataFrame:
    """The node features in one vector. concat: both as they are; encode_concat: each through its encoder first. With one
    of them alone it goes through its encoder. fusion follows in each case. N7."""
    if mode not in ("concat", "encode_concat"):
        raise ValueError(f"unknown fusion {mode!r}")
    if handcrafted is None and deep is None:
        raise ValueError("no node features")
    both = handcrafted is not None and deep is not None
    parts = [encoded(F.col(c), mlp if mode == "encode_concat" or not both else ()) for c, mlp in zip((handcrafted, deep), encoders, strict=True) if c is not None]
    given = nodes.withColumn(out, F.concat(*parts) if both else parts[0])
    return given.withColumn(out, encoded(F.col(out), fusion)) if fusion else given


@dataclass(frozen=True)
class Network:
    """Rounds of message passing. A round updates links from both ends and themselves, and nodes from the means of what
    earlier and later links bring and themselves; reattached ones get their first vector in front in each round. Heads
    turn links and nodes into the logits of their classes. N8, N10, N11."""

    rounds: int
    edge_update: Mlp
    node_update: Mlp
    edge_head: Mlp
    node_head: Mlp = ()
    edge_encoder: Mlp = ()
    reattach_nodes: bool = False
    reattach_edges: bool = False
    every_round: bool = False

    def __call__(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """((sequence_id, src, dst, round, logits), (sequence_id, index, round, logits) or nothing) for the last round, or
        for every one. nodes: (sequence_id, index, x); edges: (sequence_id, src, dst, e). Without rounds the heads see
        the encoded features. Each round is written."""
        x = nodes.select(SEQ, "index", F.col("x").cast("array<double>").alias("x"))
        e = edges.select(SEQ, "src", "dst", encoded(F.col("e"), self.edge_encoder).alias("e"))
        x, e = x.withColumn("x0", F.col("x")), e.withColumn("e0", F.col("e"))
        links, points = [], []
        for k in range(self.rounds):
            xs = x.withColumn("x", F.concat("x0", "x")) if self.reattach_nodes else x
            es = e.withColumn("e", F.concat("e0", "e")) if self.reattach_edges else e
            end = lambda name: xs.select(SEQ, F.col("index").alias(name), F.col("x").alias(f"_{name}"))  # noqa: B023, E731
            met = es.join(end("src"), [SEQ, "src"]).join(end("dst"), [SEQ, "dst"])
            e = _written(met.select(SEQ, "src", "dst", "e0", encoded(F.concat("_src", "_dst", "e"), self.edge_update).alias("e")), "net-edges")
            width = F.array_repeat(F.lit(0.0), len(self.edge_update[-1].bias))
            sent = e.withColumn("message", F.col("e"))
            own = xs.withColumn("_zeros", width)
            for name, side in (("_before", "src < dst"), ("_after", "src > dst")):
                got = messages(sent.where(side), own, "mean", "_zeros").select(SEQ, "index", F.col("message").alias(name))
                own = own.join(got, [SEQ, "index"])
            x = _written(own.select(SEQ, "index", "x0", encoded(F.concat("_before", "_after", "x"), self.node_update).alias("x")), "net-nodes")
            links.append((k, e))
            points.append((k, x))
        links, points = links or [(0, e)], points or [(0, x)]
        if not self.every_round:
            links, points = links[-1:], points[-1:]
        return self._heads(links, ("src", "dst"), "e", self.edge_head), self._heads(points, ("index",), "x", self.node_head) if self.node_head else None

    @staticmethod
    def _heads(given: list[tuple[int, DataFrame]], keys: tuple[str, ...], column: str, head: Mlp) -> DataFrame:
        parts = [df.select(SEQ, *keys, F.lit(k).alias("round"), encoded(F.col(column), head).alias("logits")) for k, df in given]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
