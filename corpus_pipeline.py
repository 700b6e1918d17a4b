"""The documents' way to training data: five operators in a row, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.bpe import VOCABULARY, encode
from trackweave.llm.common import checkpoint_dir
from trackweave.llm.kneser_ney import quality
from trackweave.llm.lines import line_dedup
from trackweave.llm.mixing import mix
from trackweave.llm.simhash import near_dedup


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, each by its id, text and language, so that a null or repeated id takes
    no other row with it."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    name = lambda c: F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit("n"))
    keys = ["__tw_i", "__tw_l", "__tw_t"]
    rejected = quality(docs, trusted).where("not keep").select(name("doc_id").alias(keys[0]), name("lang").alias(keys[1]), F.col("text_hash").alias(keys[2])).distinct()
    named = docs.withColumns(dict(zip(keys, (name("doc_id"), name("lang"), F.xxhash64("text")), strict=True)))
    return named.join(rejected.hint("shuffle_hash"), keys, "left_anti").select(*docs.columns)


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names that clash with no operator's own, and which name each column has."""
    names = {c: f"__tw_c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(c).alias(n) for c, n in names.items())), names


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go from the texts; n_chars follows."""
    given, names = _plain(docs)
    cleaned = line_dedup(given, names["doc_id"], names["text"])
    length = F.when(F.col("n_removed") > 0, F.length(names["text"]).cast("long")).otherwise(F.col(names["n_chars"]))
    return cleaned.select(*(length.alias(c) if c == "n_chars" else F.col(n).alias(c) for c, n in names.items()))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or near texts stays."""
    return near_dedup(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, as often as it takes them."""
    given, names = _plain(docs)
    taken = mix(given, names["doc_id"], names["text"], names["source"], carry=list(names.values())).where("copies > 0")
    taken = taken.withColumn("__tw_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*(F.col(n).alias(c) for c, n in names.items()))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text: doc_id, n_tokens, ids."""
    return encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("simhash near-dedup", near_deduplication),
    ("source mixing", source_mixing),
    ("byte-level bpe", token_ids),
]

#: The classifier, the fingerprints and the tokenizer can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; the result of each but the last is written to the shared folder."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
    return docs
