"""The registered queries of this subpackage, one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.kneser_ney import quality

    trusted = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return quality(_table(spark, sf_dir, "documents"), trusted)


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.html import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trackweave.llm.packing import VOCABULARY, pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op4_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.mtree import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), "pmod(vec_id, 50) = 0")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.secrets import secret_scan

    return secret_scan(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trackweave.llm.bpe import VOCABULARY, encode

    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, digest=True)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.lines import line_dedup

    return line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.media import payload_features, store

    return payload_features(store(_table(spark, sf_dir, "documents")))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from trackweave.llm.ppm import lm_scores

    learns = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    scored = lm_scores(_table(spark, sf_dir, "documents"), learns)
    return scored.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.whitening import whitened_rows

    return whitened_rows(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.merkle import tamper_report

    return tamper_report(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """The same rows by DuckDB where SQL can say them."""
    from trackweave.llm.oracles import ORACLES

    return dict(ORACLES)
