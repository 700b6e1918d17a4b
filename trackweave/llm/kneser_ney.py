"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted texts.

Blocks of whole texts count their n-grams; counts are added up and turned into the model by grouping and joining on
n-grams, so every table is sharded by n-gram. Each block then asks for the n-grams it has, the answers come back to
the block, and its texts get their perplexity. A text is rejected if its perplexity is above a quantile of what
held-out trusted texts of its language have.

Model rows: gram, alpha (the discounted probability of its last character after the others) and gamma (the weight that
the gram, as a context, leaves to the shorter one). p(c | h) = alpha(hc) + gamma(h) * p(c | h without its first
character); without such rows alpha is 0 and gamma 1. Below single characters all are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, salted_join

#: Characters of an n-gram, characters of a block of texts.
ORDER, BLOCK_CHARS = 4, 4_000_000
#: One trusted text in HELD_OUT sets thresholds instead of training; the quantile of their perplexities, and by what
#: factor a text may exceed it where all of them together are too few for the quantile, which then is the worst of them.
HELD_OUT, QUANTILE, MARGIN = 10, 0.995, 1.25
#: So much cost any text may have besides; it counts only for short ones, whose perplexity says little.
ALLOWANCE = 6.0
#: Perplexities are counted in bins of one thousandth of their logarithm, so that a quantile needs no sort.
BINS = 1000
#: What stands before a text, and what probability the characters that training never saw share.
BEGIN, UNSEEN = "\x02", 1e-7
#: Trusted ids that are sent to every task rather than shuffled (8 bytes each).
SENT = 1_000_000


def _dense(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's place among them; by counting where the range allows."""
    if len(codes) and codes.max() < 4 * len(codes) + 1_000_000:
        seen = np.zeros(int(codes.max()) + 1, np.bool_)
        seen[codes] = True
        values = np.flatnonzero(seen)
        place = np.zeros(len(seen), np.int32)
        place[values] = np.arange(len(values), dtype=np.int32)
        return values, place[codes]
    values, place = np.unique(codes, return_inverse=True)
    return values, place.astype(np.int32)


class Grams:
    """The n-grams of a block of texts: for each order the distinct grams and, for each character, which it ends.

    A gram's number is its place among the block's grams of its order. Orders above what precedes a character count
    the BEGIN marks that stand before each text."""

    def __init__(self, texts: list[str], order: int) -> None:
        pad = BEGIN * (order - 1)
        joined = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le"), "<i4")
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths + order - 1)
        self.lengths = lengths
        self.real = np.ones(len(joined), bool)
        for k in range(order - 1):
            self.real[ends - lengths - 1 - k] = False
        alphabet, at = _dense(joined)
        del joined
        self.number = [at]  # by order - 1: the gram that ends at each character
        self.shorter: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(len(alphabet), np.int32), np.zeros(len(alphabet), np.int32))]  # of each gram: its context, its suffix
        self.text: list[np.ndarray] = [alphabet[:, None]]  # code points of each gram
        for n in range(2, order + 1):
            # Half the width where the numbers allow it; they are what a block's memory goes to.
            before = self.number[-1] if len(self.text[-1]) * len(alphabet) < 1 << 31 else self.number[-1].astype(np.int64)
            codes = np.empty_like(before)
            codes[:1], codes[1:] = 0, before[:-1]
            codes *= len(alphabet)
            codes += at
            values, place = _dense(codes)
            del codes
            context, last = values // len(alphabet), values % len(alphabet)
            suffix = np.zeros(len(values), np.int32)
            suffix[place] = self.number[-1]
            self.number.append(place)
            self.shorter.append((context.astype(np.int32), suffix))
            self.text.append(np.column_stack((self.text[-1][context], alphabet[last])))

    def counts(self, chosen: np.ndarray | None = None) -> list[np.ndarray]:
        """Of each order, how often each gram ends at a character of the chosen texts."""
        of = self.real if chosen is None else self.real & np.repeat(chosen, self.lengths + len(self.number) - 1)
        return [np.bincount(a[of], minlength=len(t)) for a, t in zip(self.number, self.text, strict=True)]

    def strings(self, n: int, rows: np.ndarray) -> list[str]:
        flat = self.text[n - 1][rows].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [flat[i : i + n] for i in range(0, len(flat), n)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Whole texts in order, some BLOCK_CHARS characters together; a block's name tells its ids and lengths."""
    import xxhash

    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> tuple[int, pa.Table]:
        table = pa.Table.from_batches(held)
        lengths = pa.compute.utf8_length(table["text"]).to_pylist()
        return xxhash.xxh3_64_intdigest(repr(list(zip(table["id"].to_pylist(), lengths, strict=True)))) - (1 << 63), table

    for batch in batches:
        lengths = np.cumsum(pa.compute.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = before = 0
        while at < batch.num_rows:
            # Up to and with the text that fills the block.
            rows = min(int(np.searchsorted(lengths, before + BLOCK_CHARS - size, "left")) + 1, batch.num_rows) - at
            held.append(batch.slice(at, rows))
            at += rows
            size += int(lengths[at - 1]) - before
            before = int(lengths[at - 1])
            if size >= BLOCK_CHARS:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def packed_blocks(texts: DataFrame) -> DataFrame:
    """(block, docs): the blocks with their rows, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for name, table in _blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([zstandard.ZstdCompressor(8).compress(sink.getvalue())], pa.binary())], names=["block", "docs"])

    return texts.mapInArrow(run, "block long, docs binary")


def _unpacked(data: bytes) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """(block, gram, n): each block's grams of all orders and the empty one, with n > 0 if trusted texts have them.
    One scan gives both what the model counts and what the block will ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "gram", "n"]
        for name, table in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([""]), pa.array([0], pa.int64())], names=names)
            grams = Grams(table["text"].to_pylist(), order)
            chosen = np.array([bool(t) for t in table["trusted"].to_pylist()], bool)
            for n, counted in enumerate(grams.counts(chosen), 1):
                strings = grams.strings(n, np.arange(len(counted)))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, pa.int64()), len(strings)), pa.array(strings, pa.string()), pa.array(counted, pa.int64())], names=names)

    return texts.mapInArrow(run, "block long, gram string, n long")


def train(counted: DataFrame, order: int) -> DataFrame:
    """(gram, alpha, gamma) of the grams of the trusted texts, from (gram, n); orders 1..order together."""
    size, head, tail = F.length("gram"), (lambda c: F.substring(c, F.lit(1), F.length(c) - 1)), (lambda c: F.substring(c, F.lit(2), F.length(c) - 1))
    raw = materialize(counted.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")), "kn-counts")
    # Below the highest order a gram counts by how many characters precede it; BEGIN, which nothing precedes, by its count.
    seen = raw.where(size > 1).groupBy(tail(F.col("gram")).alias("gram")).agg(F.count(F.lit(1)).alias("kinds"))
    low = raw.where(size < order).join(seen, "gram", "left").select("gram", F.when(F.col("gram").startswith(BEGIN), F.col("n")).otherwise(F.coalesce("kinds", "n")).alias("n"))
    counts = materialize(raw.where(size == order).select("gram", "n").unionByName(low), "kn-adjusted")
    # Discounts of each order from its numbers of grams with count 1, 2, 3 and 4.
    ones = [F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    d = counts.groupBy(size.alias("size")).agg(*ones).withColumn("y", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    bounded = lambda value, most: F.greatest(F.lit(0.0), F.least(value, F.lit(most)))
    d = d.select("size", *(bounded(k - (k + 1) * F.col("y") * ratio(f"n{k + 1}", f"n{k}"), k - 0.05).alias(f"d{k}") for k in (1, 2, 3)))
    row = {r["size"]: r for r in d.collect()}  # order rows
    discount = F.lit(0.0)
    for n, r in row.items():
        own = F.when(F.col("n") == 1, r["d1"]).when(F.col("n") == 2, r["d2"]).otherwise(r["d3"])
        discount = F.when(size == n, own).otherwise(discount)
    given = counts.withColumn("cut", discount)
    contexts = given.groupBy(head(F.col("gram")).alias("gram")).agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
    contexts = materialize(contexts.select("gram", "total", (F.col("left") / F.col("total")).alias("gamma")), "kn-contexts")
    alpha = given.withColumn("context", head(F.col("gram"))).join(contexts.select(F.col("gram").alias("context"), "total"), "context")
    alpha = alpha.select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("alpha"))
    # Single precision halves what travels to the blocks.
    return alpha.join(contexts.select("gram", "gamma"), "gram", "full").select("gram", F.coalesce("alpha", F.lit(0.0)).cast("float").alias("alpha"), F.coalesce("gamma", F.lit(1.0)).cast("float").alias("gamma"))


def _scores(order: int):
    def run(key, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if len(docs) and not len(answers):
            raise ValueError("the texts have come in another order than before; write them to a table first")
        parts = []
        known = dict(zip(answers["gram"], zip(answers["alpha"].tolist(), answers["gamma"].tolist(), strict=True), strict=True))
        for data in docs["docs"]:
            table = _unpacked(data)
            grams = Grams(table["text"].to_pylist(), order)
            p = gamma = None
            for n in range(1, order + 1):
                found = [known.get(g, (0.0, 1.0)) for g in grams.strings(n, np.arange(len(grams.text[n - 1])))]
                own = np.array(found, np.float64).reshape(-1, 2)
                context, suffix = grams.shorter[n - 1]
                p = own[:, 0] + (known.get("", (0.0, 1.0))[1] * UNSEEN if n == 1 else gamma[context] * p[suffix])
                gamma = own[:, 1]
            cost = np.where(grams.real, -np.log(np.maximum(p, 1e-300))[grams.number[-1]], 0.0)
            ends = np.cumsum(grams.lengths + order - 1)
            frame = table.select(["id", "lang", "th", "trusted"]).to_pandas()
            frame["chars"], frame["cost"] = grams.lengths, np.add.reduceat(cost, ends - grams.lengths - order + 1)
            parts.append(frame)
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("id", "lang", "th", "trusted", "chars", "cost")})

    return run


def scores(texts: DataFrame, counted: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(id, lang, th, trusted, chars, cost): each text's characters and its negative log-likelihood.

    What the blocks ask for is joined with the model gram by gram; a block's answers are bounded by its characters.
    The empty gram, which every block asks for, is in the answers even if there is no model."""
    asked = counted.select("gram", "block")
    answers = asked.where("gram != ''").join(model, "gram").select("block", "gram", "alpha", "gamma")
    empty = model.where("gram = ''").agg(F.max("gamma")).first()[0]
    answers = answers.unionByName(asked.where("gram = ''").select("block", "gram", F.lit(0.0).cast("float").alias("alpha"), F.lit(1.0 if empty is None else empty).cast("float").alias("gamma")))
    kind = texts.schema["id"].dataType.simpleString()
    return packed_blocks(texts).groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_scores(order), f"id {kind}, lang string, th long, trusted boolean, chars long, cost double")


def flagged(docs: DataFrame, trusted: DataFrame, ident: str, text: str, lang: str) -> DataFrame:
    """(id, text, lang, th, trusted): th is the text's hash; trusted is true for training, false for held out, else null.

    Few trusted ids go to every task; beyond SENT of them texts and ids are shuffled, and written so that later scans
    see one order."""
    known = trusted.select(F.col(trusted.columns[0]).alias("_t")).where("_t is not null").distinct().withColumn("_trusted", F.lit(True))
    few = known.count() <= SENT
    joined = docs.select(F.col(ident).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("th"))
    joined = joined.join(F.broadcast(known) if few else known, F.col("id") == F.col("_t"), "left")
    state = F.when(F.col("_trusted"), F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) != 0)
    joined = joined.select("id", "text", "lang", "th", state.alias("trusted"))
    return joined if few else materialize(joined, "kn-texts")


def quality(docs: DataFrame, trusted: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """ident, lang, perplexity, threshold, keep and text_hash (xxhash64) for each row of ``docs``.

    trusted: a column of ids whose texts are trusted. Nine in ten of them (by the hash of the id) train; the others
    set the threshold of their language: the quantile of their perplexities, judged as texts are, with ALLOWANCE off
    their cost; times margin if all languages together have too few of them for the quantile. A language with too few of them for the quantile has the median of its own times the
    quantile of what those of all languages exceed the medians of theirs by. A language without such texts, and the
    null language, has the quantile over all languages.

    perplexity: of a character, e to the mean cost. A text is kept up to the threshold, with ALLOWANCE off its cost.
    Null or empty text: null, and it is rejected. No trusted texts at
    all: perplexities come from unseen characters alone, thresholds are null and all texts but empty ones stay. Null
    id: not trusted. Rows that repeat: a result each; trusted ids that repeat count once. Empty table: no rows. The
    rows are read twice and must come in one order, as those of a table do; otherwise the job fails.
    """
    texts = flagged(docs, trusted, ident, text, lang)
    counted = materialize(gram_counts(texts, order), "kn-grams")
    model = materialize(train(counted, order), "kn-model")
    scored = materialize(scores(texts, counted, model, order), "kn-scores")
    log = F.col("cost") / F.col("chars")
    least = (F.col("cost") - ALLOWANCE) / F.col("chars")
    bins = scored.where("trusted = false and chars > 0").select(F.coalesce("lang", F.lit("")).alias("l"), F.floor(least * BINS).alias("bin"))
    n = bins.groupBy("l", "bin").agg(F.count(F.lit(1)).alias("n"))
    both = materialize(n.unionByName(n.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("l"), "bin", "n")), "kn-bins")
    reached = lambda part: F.min(F.when(F.col("up_to") >= F.lit(part) * F.col("all"), F.col("bin")))
    up_to = lambda counted: counted.withColumns({"up_to": F.sum("n").over(Window.partitionBy("l").orderBy("bin")), "all": F.sum("n").over(Window.partitionBy("l"))})
    cut = materialize(up_to(both).groupBy("l").agg(reached(quantile).alias("own"), reached(0.5).alias("median"), F.max("all").alias("n")), "kn-cuts")
    overall, total = cut.where("l is null").agg(F.max(F.exp((F.col("own") + 1) / BINS)), F.max("n")).first()
    if (total or 0) * (1 - quantile) >= 1 - 1e-9:
        margin = 1.0
    over = both.join(cut.select("l", "median"), "l").groupBy((F.col("bin") - F.col("median")).alias("bin")).agg(F.sum("n").alias("n"))
    excess = up_to(over.withColumn("l", F.lit(""))).agg(reached(quantile)).first()[0] or 0
    bin = F.when(F.col("n") * (1 - quantile) >= 1 - 1e-9, F.col("own")).otherwise(F.col("median") + excess)
    named = cut.where("l is not null and l != ''").select(F.col("l").alias("_l"), (F.exp((bin + 1) / BINS) * margin).alias("threshold"))
    rows = scored.select("id", "lang", "th", F.coalesce("lang", F.lit("")).alias("_l"), F.when(F.col("chars") > 0, F.exp(log)).alias("perplexity"), F.when(F.col("chars") > 0, F.exp(least)).alias("_least"))
    out = salted_join(rows, named, ["_l"], "left", by=F.col("id"))
    threshold = F.coalesce("threshold", F.lit(None if overall is None else overall * margin).cast("double"))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("_least") <= threshold, F.lit(True))
    return out.select(F.col("id").alias(ident), F.col("lang").alias(lang), "perplexity", threshold.alias("threshold"), keep.alias("keep"), F.col("th").alias("text_hash"))
