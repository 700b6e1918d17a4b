"""Line dedup by winnowing: DataFrame functions only.

A *span* is a shortest stretch of consecutive lines with at least MIN_WORDS words, reaching on from its first line or
back from its last. A line goes if it lies in a span whose lines occur, as a whole, at an earlier place of the corpus
(by doc_id, then place in the text). Every run of lines that repeats with MIN_WORDS words or more is a union of such
spans, so it goes whole except where it stands first; shorter repeats stay.

How they are found: lines are hashed, a *gram* is a shortest stretch with half of MIN_WORDS, and of the grams that
start within half of MIN_WORDS words of each other the one with the least hash is kept (window minimum). Every span has
a kept gram inside, equal spans the same one. Positions are joined at equal grams; only texts that share one are looked
at further, where the spans around the shared grams, both ways, are compared by 64 and 32 bits of hash of each line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import WORD, materialize, salted_join

MIN_WORDS = 50
SPACE = " \t\n\x0b\x0c\r"


def text_lines(text: Column) -> Column:
    """The lines of a text, each with its line feed; joined they are the text."""
    return F.split(F.coalesce(text, F.lit("")), r"(?<=\n)", -1)


def winnowed_lines(docs: DataFrame, ident: str, text: str, min_words: int) -> DataFrame:
    """A line's row for each that has words: row, id, th (the text's hash), i (its place among all lines), at and stop
    (words before it and up to its end), h and g (hashes), gram: the hash of its gram if that is kept."""
    half = max(1, min_words // 2)
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    given = given.select("row", "id", "th", F.posexplode(text_lines(F.col("text"))).alias("i", "u"))
    own = F.btrim("u", F.lit(SPACE))
    rows = given.select("row", "id", "th", "i", F.regexp_count("u", F.lit(WORD)).cast("long").alias("w"), F.xxhash64(own).alias("h"), F.hash(own).alias("g")).where("w > 0")
    by_place, by_word = Window.partitionBy("row").orderBy("i"), Window.partitionBy("row").orderBy("at")
    rows = rows.withColumn("stop", F.sum("w").over(by_place)).withColumn("at", F.col("stop") - F.col("w")).drop("w")
    # A gram has the lines that start less than half of min_words on; at the text's end there are too few.
    within = by_word.rangeBetween(0, half - 1)
    rows = rows.withColumns({"_hs": F.collect_list("h").over(within), "_end": F.max("stop").over(within)})
    rows = rows.withColumn("_gram", F.when(F.col("_end") - F.col("at") >= half, F.xxhash64("_hs"))).drop("_hs", "_end")
    # A gram is kept if it is the least of one of the windows that it is in.
    reach = min_words - half
    rows = rows.withColumn("_least", F.min("_gram").over(by_word.rangeBetween(0, reach)))
    rows = rows.withColumn("_most", F.max("_least").over(by_word.rangeBetween(-reach, 0)))
    return rows.withColumn("gram", F.when(F.col("_gram") == F.col("_most"), F.col("_gram"))).drop("_gram", "_least", "_most")


def _place(at: str) -> Column:
    return F.struct(F.col("id").isNull(), "id", "th", at)


def repeated_runs(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, first, last): runs of lines, apart from each other, that repeat earlier ones; th: the hash of their text."""
    rows = materialize(winnowed_lines(docs, ident, text, min_words), "line-rows")
    grams = rows.where("gram is not null").select("row", "at", "gram")
    # Grams at two places or more; counts are formed before the shuffle, so a hot passage costs a row a task.
    twice = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    shared = materialize(salted_join(grams, twice, ["gram"], "left_semi", by=F.col("row")).select("row", "at"), "line-shared")
    near = rows.drop("gram").join(shared.select("row").distinct().hint("shuffle_hash"), "row", "left_semi")
    near = near.join(shared.withColumn("hit", F.lit(1)).hint("shuffle_hash"), ["row", "at"], "left")
    # Spans on from each line and back from each, near a shared gram.
    half = max(1, min_words // 2)
    start = Window.partitionBy("row").orderBy("at")
    on, back = start.rangeBetween(0, min_words - 1), Window.partitionBy("row").orderBy("stop").rangeBetween(1 - min_words, 0)
    key = [F.collect_list("h"), F.collect_list("g")]
    onward = near.select("id", "th", F.col("i").alias("first"), F.max("i").over(on).alias("last"), (F.max("stop").over(on) - F.col("at")).alias("words"), *(k.over(on).alias(n) for k, n in zip(key, "hg", strict=True)), F.max("hit").over(start.rangeBetween(0, min_words - half)).alias("hit"))
    backward = near.select("id", "th", F.min("i").over(back).alias("first"), F.col("i").alias("last"), (F.col("stop") - F.min("at").over(back)).alias("words"), *(k.over(back).alias(n) for k, n in zip(key, "hg", strict=True)), F.max("hit").over(back).alias("hit"))
    spans = onward.union(backward).where(F.col("hit").isNotNull() & (F.col("words") >= min_words))
    spans = materialize(spans.select(F.xxhash64("h").alias("k0"), F.xxhash64(F.lit(1), "g").alias("k1"), "id", "th", "first", "last"), "line-spans")
    first = spans.groupBy("k0", "k1").agg(F.min(_place("first")).alias("lo"), F.max(_place("first")).alias("hi")).where("lo != hi").select("k0", "k1", "lo")
    later = salted_join(spans, first, ["k0", "k1"], by=F.xxhash64("id", "first")).where(_place("first") > F.col("lo")).select("id", "th", "first", "last").distinct()
    ordered = Window.partitionBy("id", "th").orderBy("first", "last")
    before = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("apart", F.coalesce((F.col("first") > before + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("apart").over(ordered))
    return later.groupBy("id", "th", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def line_dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later repeats of runs of lines taken out of ``text``; other columns pass, n_removed (int, the
    lines that went) is added; a column of that name is replaced.

    Lines are what line feeds end. Lines without words don't count in a run; those inside a removed run go with it.
    White space at the end of a text that has lost something goes. A text with no repeat stays as it is, byte for byte;
    one that is all repeat becomes the empty text. Null text stays null and repeats nothing. Rows that repeat both id
    and text count as one row and get the same result; rows with the same id and other text are ordered by the text's
    hash; rows with a null id come last. Equal texts under different ids: all but the first lose their runs. Texts may
    be of any length: work is in proportion to lines. What a line shares with unlike lines stays. Empty table: no rows.
    """
    gone = repeated_runs(docs, ident, text, min_words)
    gone = gone.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("__tw_gone"))
    name = lambda c: F.coalesce(F.concat(F.lit("i"), c.cast("string")), F.lit("n"))
    gone = gone.select(name(F.col("id")).alias("__tw_k"), F.col("th").alias("__tw_th"), "__tw_gone").hint("shuffle_hash")
    keyed = docs.withColumn("__tw_k", name(F.col(ident))).withColumn("__tw_th", F.xxhash64(text))
    out = keyed.join(gone, ["__tw_k", "__tw_th"], "left")
    has = F.col("__tw_gone").isNotNull()
    out = out.withColumn("__tw_u", F.when(has, text_lines(F.col(text))))
    # What lies before each run and behind the last.
    begins = "if(k = 1, 0, element_at(__tw_gone, k - 1).last + 1)"
    ends = "if(k > size(__tw_gone), size(__tw_u), element_at(__tw_gone, k).first)"
    pieces = f"transform(sequence(1, size(__tw_gone) + 1), k -> array_join(slice(__tw_u, {begins} + 1, greatest(0, {ends} - {begins})), ''))"
    cleaned = F.when(has, F.rtrim(F.expr(f"array_join({pieces}, '')"), F.lit(SPACE))).otherwise(F.col(text))
    removed = F.coalesce(F.expr("aggregate(__tw_gone, 0, (a, x) -> a + x.last - x.first + 1)"), F.lit(0))
    names = [c for c in docs.columns if c != "n_removed"]
    return out.select(*[cleaned.alias(c) if c == text else F.col(c) for c in names], removed.alias("n_removed"))
