"""Partial matching, whitening and the Merkle manifest against brute force written for the tests."""

import math
import zlib
from collections import Counter, defaultdict
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import merkle, ppm, whitening

# ---- partial matching ----


def tokens_of(text):
    return [w.lower() for w in (text or "").encode().split()] + [b"\n"]


def slow_ppm(trained, text, order):
    """log10 probability by walking contexts from dictionaries, without the library's code."""
    trie = defaultdict(Counter)
    for t in trained:
        body = b"\n" * order + b" ".join(tokens_of(t)[:-1]) + b"\n"
        for i in range(order, len(body)):
            for k in range(order + 1):
                trie[body[i - k : i]][body[i]] += 1
    body = b"\n" * order + b" ".join(tokens_of(text)[:-1]) + b"\n"
    total = 0.0
    for i in range(order, len(body)):
        out = set()
        for k in range(order, -1, -1):
            after = trie.get(body[i - k : i])
            if not after:
                continue
            left = {b: n for b, n in after.items() if b not in out}
            whole = sum(left.values()) + len(left)
            if body[i] in left:
                total += math.log10(left[body[i]] / whole)
                break
            if left:
                total += math.log10(len(left) / whole)
            out |= set(left)
        else:
            total -= math.log10(256 - len(out))
    return total


TEXTS = [
    (1, "The cat sat on the mat. The cat sat."), (2, "the DOG sat on\tthe log"), (3, None), (4, ""), (5, "   \n "), (6, "zebra é ü 中文 unseen"),
    (7, "a"), (None, "no id at all, the cat"), (7, "a"), (8, "x" * 5000 + " the cat"),
]


@pytest.mark.parametrize("order", [3, 4, 6])
@pytest.mark.parametrize("block", [40, 1_000_000])
def test_partial_matching(spark, order, block):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in TEXTS], "doc_id long, text string, score string, block double")
    learns = F.pmod("doc_id", F.lit(3)) != 0
    rows = ppm.lm_scores(docs, learns, order=order, block_bytes=block).collect()
    trained = [t for i, t in TEXTS if i is None or i % 3]
    counts = Counter(w for t in trained for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in TEXTS:
        own = tokens_of(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append((str(i), i is None or i % 3 != 0, len(own), sum(w in counts for w in own), n, round(base, 6), round(slow_ppm(trained, t, order), 6)))
    got = [(str(r.doc_id), r.learns, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows]
    assert sorted(got) == sorted(want)


def test_partial_matching_without_training_or_rows(spark):
    docs = spark.createDataFrame([(1, "ab c")], "doc_id long, text string")
    (row,) = ppm.lm_scores(docs, F.lit(False)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert math.isclose(row.score, -5 * math.log10(256))
    assert ppm.lm_scores(docs.limit(0), F.lit(True)).collect() == []


def test_probabilities_of_a_context_add_up():
    bodies = [ppm.normal(t.encode()) for t in ("abracadabra abra", "abcd bcda", "banana")]
    order = 3
    keys, n = ppm.counted(bodies, np.ones(3, bool), order)
    low = ppm.counted(bodies, np.ones(3, bool), 2)
    for context in (int(keys[0] >> 8), int(keys[5] >> 8), int.from_bytes(b"\xff\xff\xff", "big"), int.from_bytes(b"a\xff\xff", "big")):
        every = np.arange(256, dtype=np.int64) | context << 8
        asked = np.union1d(keys, every)
        counts = np.zeros(len(asked), np.int64)
        counts[np.searchsorted(asked, keys)] = n
        p = 10 ** ppm.log_probabilities(asked, counts, low, order)[np.searchsorted(asked, every)]
        assert math.isclose(p.sum(), 1, rel_tol=1e-12)


def test_pieces_of_long_texts_agree():
    bodies = [ppm.normal(b"lorem ipsum dolor " * 50), ppm.normal(b""), ppm.normal(b"sit amet")]
    whole = np.concatenate([g for g, _ in ppm.pieces(bodies, 5)])
    small = list(ppm.pieces(bodies, 5, 7))
    assert (np.concatenate([g for g, _ in small]) == whole).all() and len(whole) == sum(map(len, bodies))
    assert (np.bincount(np.concatenate([t for _, t in small])) == [len(b) for b in bodies]).all()
    keys = np.unique(whole)
    assert (ppm.Places(keys).of(whole) == np.searchsorted(keys, whole)).all()


def test_adaptive_coding(spark):
    docs = spark.createDataFrame([(1, "abab abab abab abab " * 20), (2, None), (3, "q")], "doc_id long, text string")
    rows = {r.doc_id: r for r in ppm.adaptive_scores(docs, order=3).collect()}
    assert math.isclose(rows[2].score, -math.log10(256)) and rows[2].n_bytes == 1
    assert -rows[1].score / rows[1].n_bytes < 0.1  # repeats cost little
    # The first byte costs 8 bits; then the order 0 node has one follower with count one: escape 1/2, 255 bytes left.
    assert math.isclose(rows[3].score, -math.log10(256) - math.log10(2) - math.log10(255))


def test_held_out_texts_cost_little_more_than_their_source(spark):
    import random

    rnd = random.Random(5)
    syllables = ["ka", "lo", "mi", "ren", "tos", "vu", "sha"]
    docs = [(i, " ".join("".join(rnd.choices(syllables, k=rnd.randint(4, 7))) for _ in range(60))) for i in range(200)]
    entropy = 60 * (5.5 * math.log10(7) + math.log10(4))
    rows = ppm.lm_scores(spark.createDataFrame(docs, "doc_id long, text string"), F.pmod("doc_id", F.lit(10)) != 0).where("not learns").collect()
    assert len(rows) == 20 and 0.9 * entropy < -sum(r.score for r in rows) / 20 < 1.2 * entropy


# ---- whitening ----


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6)).astype(np.float32)
    rows = [(i, base[i % 37].tolist(), "x") for i in range(120)] + [(200, None, "x"), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (202, [float("nan")] * 6, "x"), (203, [math.inf] * 6, "x"), (204, [], "x"), (205, [1.0], "x"), (None, base[0].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")
    for weight in ("one", "count"):
        got = whitening.whiten(df, weight=weight).collect()
        held = [np.floor(base[i % 37].astype(np.float64) * 64).astype(np.int64) + 1_000_000 for i in [*range(120), 0]]
        x = np.array(held)
        fit = np.unique(x, axis=0) if weight == "one" else x
        n, sums = len(fit), fit.sum(axis=0)
        y = fit - sums / n
        cov = y.T @ y / n
        values = np.linalg.eigvalsh(cov)[::-1]
        assert len(got) == 121 and {r.n for r in got} == {n} and all(r.identity_error < 1e-9 for r in got)
        w = np.array([r.whitened for r in got])
        assert np.allclose(got[0].explained, values / np.trace(cov))
        by = {r.vec_id: r for r in got}
        for i, v in zip([*range(120), None], held, strict=True):
            assert by[i].deviation == Decimal(int(((n * v - sums) ** 2).sum()))
            # Whatever the signs, lengths agree with the inverse of the covariance.
            assert math.isclose(sum(c * c for c in by[i].whitened), float((v - sums / n) @ np.linalg.inv(cov) @ (v - sums / n)), rel_tol=1e-8)
        if weight == "count":
            assert np.allclose(np.cov(w.T, bias=True), np.eye(6), atol=1e-9)
    long = whitening.whitened_rows(df, most=4)
    assert long.count() == 121 * 4 and {r.component for r in long.select("component").distinct().collect()} == {1, 2, 3, 4}


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.n, int(r.deviation), r.whitened, r.identity_error) for r in whitening.whiten(df).collect()] == [(1, 0, [], None)] * 2
    assert whitening.whitened_rows(df).collect() == [] and whitening.whiten(df.limit(0)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert all(len(r.whitened) == 1 and r.identity_error < 1e-9 for r in whitening.whiten(flat).collect())
    huge = spark.createDataFrame([(1, [3e30, 1.0]), (2, [1.0, 1.0]), (3, [0.5, 2.0])], "vec_id long, embedding array<double>")
    assert len(whitening.whiten(huge).collect()) == 3


# ---- Merkle manifest ----


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def slow_tree(digests):
    """The root and, for each leaf, its steps (l or r and a digest, or nothing), level by level."""
    steps, where, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for s, i in zip(steps, where, strict=True):
            s.append("" if i ^ 1 >= len(nodes) else ("l" if i & 1 else "r") + nodes[i ^ 1])
        where = [i // 2 for i in where]
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], steps


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def slow_manifest(rows):
    made = [(d, lang, h(*map(field, (d, source, lang, n, text))), (d, source, lang, n, text)) for d, text, lang, source, n in rows]
    groups = defaultdict(list)
    for r in made:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: slow_tree([r[2] for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]) for g in groups}
    root, upper = slow_tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, upper, strict=True):
        for r, steps in zip(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[2])), trees[g][1], strict=True):
            proof = steps + up
            d, source, lang, n, text = r[3]
            now = r[2] if d is None or n is None or zlib.crc32(str(d).encode()) % 7 else h(*map(field, (d, source, lang, n + 1, text)))
            for s in proof:
                now = h(now) if not s else h(s[1:], now) if s[0] == "l" else h(now, s[1:])
            out.append((str(d), r[2], trees[g][0], root, h(*(s[1:] for s in proof)), now, now == root))
    return sorted(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def report(df):
    return sorted(tuple(str(v) if k == "doc_id" else v for k, v in r.asDict().items()) for r in merkle.tamper_report(df).collect())


def test_manifest_with_odd_rows(spark):
    rows = [(i, f"tëxt {i}", ["en", "de", "é", None, "solo"][min(i % 5, 4 if i == 4 else 3)], "s", 7 * i) for i in range(57)]
    rows += [(None, None, None, None, None), (None, "x", "en", None, 3), (3, "again", "en", "s", None), (3, "again", "en", "s", None), (99, "y" * 100_000, "de", "", 100_000), (100, "", "", "s", 0)]
    assert report(spark.createDataFrame(rows, SCHEMA)) == slow_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 65])
def test_manifest_sizes_and_rounds(spark, n):
    rows = [(i, str(i), "en", "s", i) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("clash")).withColumn("tree", F.lit(1))
    assert report(df) == slow_manifest(rows)
    # Small blocks: several rounds give the same.
    for bits in {3: (1,), 65: (3,)}.get(n, ()):
        got = sorted((r.doc_id, r.leaf, r.root, tuple(r.proof)) for r in merkle.manifest(df, bits=bits).collect())
        root, steps = slow_tree([h(*map(field, (i, "s", "en", i, str(i)))) for i in range(n)])
        assert got == [(i, h(*map(field, (i, "s", "en", i, str(i)))), root, tuple(s)) for i, s in enumerate(steps)]


def test_manifest_of_no_rows(spark):
    assert merkle.tamper_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_queue_stays_small(monkeypatch):
    most = 0
    push = merkle.heapq.heappush

    def watched(queue, item):
        nonlocal most
        push(queue, item)
        most = max(most, len(queue))

    monkeypatch.setattr(merkle.heapq, "heappush", watched)
    n = 4096
    made = list(merkle.sweep(((i, b"%d" % i) for i in range(n)), n, 12))
    assert len(made) == n - 1 and most <= 14
