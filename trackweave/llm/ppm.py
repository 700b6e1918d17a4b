"""Language-model scoring by prediction by partial matching over bytes.

A text is its words, lower-cased, with a space between and a line feed at the end; the ``order`` bytes before each byte
are its context (line feeds before a text). The trie has a node for each context of at most ``order`` bytes that
training texts have, with the count of each byte that follows. A byte is looked for in the longest context that the trie
has; if it never followed there, that costs an escape (method C: distinct followers to all counts and distinct
followers) and the next shorter context is asked, from which the followers of the longer one are excluded. Below the
empty context all bytes that training never had are equally likely.

How it is spread: blocks of whole texts are written once and each reports its distinct grams (a context of full length
and its byte) with their training counts. Counts are added up by gram; the nodes of the trie are formed where the grams
meet that share the last three bytes of context, so a task holds at most 256 ** (order - 2) grams a key; contexts of at
most two bytes have at most 256 ** 3 counts, which go to all tasks. Each distinct gram gets its code length once, blocks
get those that they have, and their texts add them up. Within a block a gram is reported once, so no key is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, spark_parts

#: Bytes of the longest context; bytes of a block of texts, and of what is turned into grams at once.
ORDER, BLOCK_BYTES, CHUNK_BYTES = 4, 16_000_000, 1_000_000
#: Bytes of context whose nodes are formed together.
KEY_BYTES = 3
#: What ends a text and stands before it.
END = b"\n"


def normal(text: bytes | None) -> bytes:
    """The byte sequence that is scored; words are what space and bytes 9 to 13 separate."""
    return b" ".join((text or b"").lower().split()) + END


def pieces(bodies: list[bytes], order: int, chunk: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, text): of about ``chunk`` bytes at a time each byte's gram and the place of its text in ``bodies``.

    A gram has its context from the last byte on in its upper bytes and the byte itself in its lowest."""
    held: list[tuple[bytes, bytes, int]] = []
    size = 0

    def grams() -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(part for before, body, _ in held for part in (before, body)), np.uint8)
        lengths = np.array([len(body) for _, body, _ in held], np.int64)
        ends = np.cumsum(lengths + order)
        real = np.ones(len(flat), bool)
        real[((ends - lengths - order)[:, None] + np.arange(order)).ravel()] = False
        at = np.flatnonzero(real)
        keys = flat[at].astype(np.int64)
        for j in range(1, order + 1):
            keys |= flat[at - j].astype(np.int64) << (8 * (order + 1 - j))
        return keys, np.repeat(np.array([i for *_, i in held], np.int64), lengths)

    for i, body in enumerate(bodies):
        for begin in range(0, len(body), chunk):
            before = (END * order + body[max(0, begin - order) : begin])[-order:]
            held.append((before, body[begin : begin + chunk], i))
            size += len(held[-1][1])
            if size >= chunk:
                yield grams()
                held, size = [], 0
    if held:
        yield grams()


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of sorted ones in order, counts added up."""
    every = np.concatenate([np.zeros(0, np.int64), *keys])
    if not len(every):
        return every, every
    sort = np.argsort(every, kind="stable")
    every = every[sort]
    begins = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[begins], np.add.reduceat(np.concatenate(counts)[sort], begins)


def counted(bodies: list[bytes], learns: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams in order, and how often those texts have them that train."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for part, text in pieces(bodies, order):
        of = learns[text]
        own, n = np.unique(part[of], return_counts=True)
        rest = np.unique(part[~of])
        keys += [own, rest]
        counts += [n, np.zeros(len(rest), np.int64)]
        if len(keys) >= 8:
            key, n = merged(keys, counts)
            keys, counts = [key], [n]
    return merged(keys, counts)


class Places:
    """Where each of many grams stands among sorted ones, all of which are there: two hash tables, then a search."""

    FACTORS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.tables = []
        for f in self.FACTORS:
            table = np.zeros(1 << (64 - int(self.shift)), np.int32)
            table[self._slots(keys, f)] = np.arange(len(keys), dtype=np.int32)
            self.tables.append(table)

    def _slots(self, keys: np.ndarray, factor: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(factor)) >> self.shift

    def of(self, wanted: np.ndarray) -> np.ndarray:
        at = self.tables[0][self._slots(wanted, self.FACTORS[0])]
        missed = np.flatnonzero(self.keys[at] != wanted)
        again = self.tables[1][self._slots(wanted[missed], self.FACTORS[1])]
        at[missed] = again
        missed = missed[self.keys[again] != wanted[missed]]
        at[missed] = np.searchsorted(self.keys, wanted[missed])
        return at


class Level:
    """The trie's nodes of one context length: followers with counts, and of each node total and number of followers."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        seen = counts > 0
        self.grams, place = np.unique(grams[seen], return_inverse=True)
        self.n = np.bincount(place, weights=counts[seen], minlength=len(self.grams)).astype(np.int64)
        self.nodes, self.begins, self.kinds = np.unique(self.grams >> 8, return_index=True, return_counts=True)
        self.total = np.add.reduceat(self.n, self.begins) if len(self.nodes) else self.n

    def follower(self, grams: np.ndarray) -> np.ndarray:
        """The count of each gram, 0 if it isn't there."""
        return _at(self.grams, self.n, grams)

    def shared(self, shorter: Level) -> np.ndarray:
        """Of each node, the total that its followers have in the context one byte shorter."""
        if not len(self.nodes):
            return self.total
        return np.add.reduceat(shorter.follower((self.grams >> 16) << 8 | self.grams & 255), self.begins)


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def shortened(grams: np.ndarray, order: int, k: int) -> np.ndarray:
    """The grams with a context of k bytes."""
    return (grams >> (8 * (order - k + 1))) << 8 | grams & 255


def log_probabilities(grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context.

    grams, counts: all that share the last KEY_BYTES bytes of context with one of them; low: counts of all grams with
    contexts of KEY_BYTES - 1 bytes."""
    top = KEY_BYTES - 1
    levels = {k: Level(shortened(grams, order, k), counts) for k in range(KEY_BYTES, order + 1)}
    levels |= {k: Level(shortened(low[0], top, k), low[1]) for k in range(top + 1)}
    cost = np.zeros(len(grams))
    done = np.zeros(len(grams), bool)
    # Followers of the longer context, and their total in this one; none if the longer context isn't there.
    kinds_out = total_out = np.zeros(len(grams), np.int64)
    for k in range(order, -1, -1):
        level, own = levels[k], shortened(grams, order, k)
        kinds, total = (_at(level.nodes, x, own >> 8) for x in (level.kinds, level.total))
        n, escape = level.follower(own), kinds - kinds_out
        weight = total - total_out + escape
        with np.errstate(divide="ignore", invalid="ignore"):
            found, missed = np.log10(n / weight), np.where(escape > 0, np.log10(escape / weight), 0.0)
        cost += np.where(done, 0.0, np.where(n > 0, found, missed))
        done |= n > 0
        if k:
            kinds_out, total_out = kinds, _at(level.nodes, level.shared(levels[k - 1]), own >> 8)
    return np.where(done, cost, cost - np.log10(max(1, 256 - len(levels[0].grams))))


def adaptive_score(body: bytes, order: int) -> float:
    """log10 probability of one normal() text by a trie that starts empty and learns each byte after it is coded."""
    trie: dict[bytes, Counter] = {}
    given, cost = END * order + body, 0.0
    for i in range(order, len(given)):
        byte, out = given[i], set()
        for k in range(order, -1, -1):
            followers = trie.get(given[i - k : i])
            if not followers:
                continue
            left = {b: n for b, n in followers.items() if b not in out}
            weight = sum(left.values()) + len(left)
            if byte in left:
                cost += np.log10(left[byte] / weight)
                break
            cost += np.log10(len(left) / weight) if left else 0.0
            out |= left.keys()
        else:
            cost -= np.log10(256 - len(out))
        for k in range(order + 1):
            trie.setdefault(given[i - k : i], Counter())[byte] += 1
    return float(cost)


def _pack(table: pa.Table) -> bytes:
    import zstandard

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.ZstdCompressor(3).compress(sink.getvalue())


def _unpack(data: bytes) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


def text_blocks(docs: DataFrame, ident: str, text: str, learns: Column, size: int = BLOCK_BYTES) -> DataFrame:
    """(block, docs): whole texts, some ``size`` bytes together, as bytes to score. Written, so that later scans see the
    same blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Array] = []
        flags: list[bool] = []
        bodies: list[bytes] = []

        def block() -> pa.RecordBatch:
            table = pa.table({"id": pa.chunked_array(ids), "learns": pa.array(flags, pa.bool_()), "body": pa.array(bodies, pa.large_binary())})
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), pa.array([_pack(table)], pa.binary())], names=["block", "docs"])

        for batch in batches:
            for i, (value, flag) in enumerate(zip(batch.column(2).cast(pa.large_binary()), batch.column(1), strict=True)):
                bodies.append(normal(value.as_py()))
                flags.append(flag.as_py())
                ids.append(batch.column(0).slice(i, 1))
                held += len(bodies[-1])
                if held >= size:
                    yield block()
                    ids, flags, bodies, held, made = [], [], [], 0, made + 1
        if bodies:
            yield block()

    given = docs.select(F.col(ident).alias("id"), F.coalesce(learns, F.lit(True)).alias("learns"), F.col(text).alias("text"))
    return materialize(given.mapInArrow(run, "block long, docs binary"), "ppm-blocks")


def block_reports(blocks: DataFrame, order: int) -> DataFrame:
    """(block, gram, word, n): each block's distinct grams (word null) and distinct tokens (gram null), the end as one
    of them, with their counts in texts that train."""
    names = ["block", "gram", "word", "n"]

    def rows(block: int, grams: pa.Array, words: pa.Array, n: pa.Array) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(n), 50_000):
            part = [x.slice(i, 50_000) for x in (grams, words, n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[2]), block)), *part], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = _unpack(data.as_py())
                bodies, learns = table["body"].to_pylist(), table["learns"].to_numpy()
                keys, n = counted(bodies, learns, order)
                yield from rows(block, pa.array(keys), pa.nulls(len(keys), pa.binary()), pa.array(n))
                del keys
                seen: Counter = Counter({END: int(learns.sum())})
                rest: set[bytes] = set()
                for body, of in zip(bodies, learns, strict=True):
                    seen.update(body.split()) if of else rest.update(body.split())
                rest -= seen.keys()
                words = sorted([*seen, *rest])
                yield from rows(block, pa.nulls(len(words), pa.int64()), pa.array(words, pa.binary()), pa.array([seen[w] for w in words], pa.int64()))

    return blocks.select("block", "docs").mapInArrow(run, "block long, gram long, word binary, n long")


def gram_scores(totals: DataFrame, order: int) -> DataFrame:
    """(gram, score): log10 probability of each distinct gram of (gram, n)."""
    byte, context = F.col("gram").bitwiseAND(F.lit(255)), F.shiftright("gram", 8 * (order + 2 - KEY_BYTES))
    # At most 256 ** KEY_BYTES rows, whatever the texts.
    low = totals.where("n > 0").groupBy(F.shiftleft(context, 8).bitwiseOR(byte).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    sent = totals.sparkSession.sparkContext.broadcast((np.asarray(low["gram"]), np.asarray(low["n"])))

    def run(rows: pa.Table) -> pa.Table:
        keys = rows["gram"].to_numpy()
        return pa.table({"gram": keys, "score": log_probabilities(keys, rows["n"].to_numpy(), sent.value, order)})

    part = F.pmod(F.xxhash64(F.shiftright("gram", 8 * (order + 1 - KEY_BYTES))), F.lit(4 * spark_parts(totals)))
    return totals.withColumn("part", part).groupBy("part").applyInArrow(run, "gram long, score double")


def _texts(order: int):
    names = ["id", "learns", "n_tokens", "n_known", "known_log", "score"]

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        words = answers.filter(answers["gram"].is_null())
        counts = dict(zip(words["word"].to_pylist(), words["value"].to_pylist(), strict=True))
        answers = answers.filter(answers["gram"].is_valid()).select(["gram", "value"]).sort_by("gram")
        places, scores = Places(answers["gram"].to_numpy()), answers["value"].to_numpy()
        out = []
        for data in docs["docs"]:
            table = _unpack(data.as_py())
            bodies = table["body"].to_pylist()
            score = np.zeros(len(bodies))
            for part, text in pieces(bodies, order):
                score += np.bincount(text, weights=scores[places.of(part)], minlength=len(bodies))
            tokens, known, logs = (np.zeros(len(bodies), t) for t in (np.int64, np.int64, np.float64))
            for i, body in enumerate(bodies):
                c = np.fromiter(map(counts.__getitem__, [*body.split(), END]), np.float64)
                tokens[i], known[i], logs[i] = len(c), np.count_nonzero(c), np.log10(c + SMOOTH).sum()
            out.append(pa.table([table["id"], table["learns"], tokens, known, logs, score], names=names))
        return pa.concat_tables(out)

    return run


#: What each token's count is raised by in the base model.
SMOOTH = 0.1


def lm_scores(docs: DataFrame, learns: Column, ident: str = "doc_id", text: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """ident, learns, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    learns: whether a row's text trains the models; null counts as true. Tokens are words and one end a text. base_score
    is the log10 probability by word counts raised by SMOOTH, score that by partial matching over the bytes of the same
    tokens, both by all texts that train. order: from KEY_BYTES to 6.

    Null or empty text, or white space alone: one token, the end. Texts of any length: grams are formed CHUNK_BYTES at a
    time. No text trains: all bytes are equally likely and base_score is 0. Null id, rows that repeat: a result each.
    Empty table: no rows. Other columns play no part.
    """
    if not KEY_BYTES <= order <= 6:
        raise ValueError(f"order is from {KEY_BYTES} to 6")
    blocks = text_blocks(docs, ident, text, learns, block_bytes)
    reports = materialize(block_reports(blocks, order), "ppm-reports")
    grams, words = reports.where("word is null").select("block", "gram", "n"), reports.where("gram is null").select("block", "word", "n")
    gram_totals = materialize(grams.groupBy("gram").agg(F.sum("n").alias("n")), "ppm-grams")
    word_totals = materialize(words.groupBy("word").agg(F.sum("n").alias("n")), "ppm-words")
    n, kinds = word_totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    scored = gram_scores(gram_totals, order)
    none = lambda kind: F.lit(None).cast(kind)
    answers = grams.join(scored.hint("shuffle_hash"), "gram").select("block", "gram", none("binary").alias("word"), F.col("score").alias("value"))
    answers = answers.unionByName(words.select("block", "word").join(word_totals.hint("shuffle_hash"), "word").select("block", none("long").alias("gram"), "word", F.col("n").cast("double").alias("value")))
    kind = docs.schema[ident].dataType.simpleString()
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_texts(order), f"id {kind}, learns boolean, n_tokens long, n_known long, known_log double, score double")
    base = F.col("known_log") - F.col("n_tokens") * float(np.log10(n + SMOOTH * (kinds + 1)))
    return out.select(F.col("id").alias(ident), "learns", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def adaptive_scores(docs: DataFrame, ident: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """ident, n_bytes, score: each text coded by a trie of its own that learns as it goes; cases as in lm_scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [normal(v.as_py()) for v in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, bodies), pa.int64()), pa.array([adaptive_score(b, order) for b in bodies], pa.float64())], names=["id", "n_bytes", "score"])

    kind = docs.schema[ident].dataType.simpleString()
    out = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, score double")
    return out.withColumnRenamed("id", ident)
