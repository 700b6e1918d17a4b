"""Small networks against numpy."""

import numpy as np
import pytest

from trackweave.operators.layers import Dense, Network, encoded, fused


def dense(rng, n_in, n_out, norm=False, relu=True):
    return Dense(rng.normal(size=(n_out, n_in)), rng.normal(size=n_out), (rng.normal(size=n_out), rng.normal(size=n_out)) if norm else None, relu)


def through(x, mlp):
    for layer in mlp:
        x = x @ layer.weights.T + layer.bias
        if layer.norm:
            x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * layer.norm[0] + layer.norm[1]
        x = np.maximum(x, 0) if layer.relu else x
    return x


def test_fusion(spark):
    rng = np.random.default_rng(1)
    hand, deep = rng.normal(size=(9, 3)), rng.normal(size=(9, 5))
    df = spark.createDataFrame([("s", i, hand[i].tolist(), deep[i].tolist()) for i in range(9)] + [("s", 9, None, None)], "sequence_id string, index long, h array<double>, d array<double>")
    encoders, fusion = ((dense(rng, 3, 4, True),), (dense(rng, 5, 6), dense(rng, 6, 2))), (dense(rng, 6, 7, True, False),)
    plain = (dense(rng, 8, 2),)
    for args, want in (
        ((("h", "d", "encode_concat", encoders, fusion)), through(np.hstack([through(hand, encoders[0]), through(deep, encoders[1])]), fusion)),
        ((("h", "d", "concat", encoders, plain)), through(np.hstack([hand, deep]), plain)),
        ((("h", None, "concat", encoders, ())), through(hand, encoders[0])),
        (((None, "d", "encode_concat", encoders, ())), through(deep, encoders[1])),
    ):
        got = {r["index"]: r.features for r in fused(df, *args).collect()}
        assert np.allclose([got[i] for i in range(9)], want) and got[9] is None
    with pytest.raises(ValueError):
        fused(df, None, None)
    with pytest.raises(ValueError):
        fused(df, "h", "d", "sum")
    assert df.where("index < 3").select(encoded(df["h"], ()).alias("x")).count() == 3


@pytest.mark.parametrize("reattach", [False, True])
def test_two_rounds(spark, reattach):
    rng = np.random.default_rng(2)
    n, width, edge = 6, 3, 2
    x = rng.normal(size=(n, width))
    pairs = [(0, 1), (1, 0), (1, 2), (2, 1), (3, 1), (0, 4), (4, 0)]
    e = rng.normal(size=(len(pairs), edge))
    times = 2 if reattach else 1
    net = Network(2, (dense(rng, times * (2 * width + edge), edge, True),), (dense(rng, 2 * edge + times * width, width),), (dense(rng, edge, 3, relu=False),), (dense(rng, width, 2, relu=False),), (dense(rng, edge, edge),), reattach, reattach, True)
    nodes = spark.createDataFrame([("s", i, x[i].tolist()) for i in range(n)], "sequence_id string, index long, x array<double>")
    edges = spark.createDataFrame([("s", a, b, e[k].tolist()) for k, (a, b) in enumerate(pairs)], "sequence_id string, src long, dst long, e array<double>")
    links, points = net(nodes, edges)
    ex, ee = x, through(e, net.edge_encoder)
    x0, e0 = ex, ee
    got_e = {(r.round, r.src, r.dst): r.logits for r in links.collect()}
    got_x = {(r.round, r["index"]): r.logits for r in points.collect()}
    for k in range(2):
        xs, es = (np.hstack([x0, ex]), np.hstack([e0, ee])) if reattach else (ex, ee)
        ee = through(np.array([np.concatenate([xs[a], xs[b], es[i]]) for i, (a, b) in enumerate(pairs)]), net.edge_update)
        mean = lambda i, early: np.mean([ee[j] for j, (a, b) in enumerate(pairs) if b == i and (a < b) == early] or [np.zeros(edge)], axis=0)  # noqa: B023, E731
        ex = through(np.array([np.concatenate([mean(i, True), mean(i, False), xs[i]]) for i in range(n)]), net.node_update)
        assert np.allclose([got_e[k, a, b] for a, b in pairs], through(ee, net.edge_head)) and np.allclose([got_x[k, i] for i in range(n)], through(ex, net.node_head))
    assert len(got_e) == 2 * len(pairs) and len(got_x) == 2 * n
    none, nothing = Network(0, (), (), net.edge_head, ())(nodes, edges)
    assert nothing is None and np.allclose(sorted(r.logits for r in none.collect()), sorted(through(e, net.edge_head).tolist()))
