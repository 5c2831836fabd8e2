"""The thin queries of the training-data operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, chroma, decontaminate, factorization, hmm, repair, setsketch, wrappers
from . import quality as quality_
from .common import table


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(spark, table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(spark, table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorization.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_.quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    blocks = repair.write(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return repair.digests(repair.read(spark, blocks))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, only=("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))


def op9_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op10_chroma_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.search(spark, chroma.media(table(spark, sf_dir, "embeddings")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hmm_score, op2_chat, op3_main_text, op4_toxicity, op5_quality, op6_token_ids, op7_decontaminate, op8_byte_bpe,
        op9_setsketch_dedup, op10_chroma_search,
    )
}

ORACLE_SQL = {"op2_chat": chat.ORACLE_SQL}
