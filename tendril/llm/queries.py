"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_bpe_encode_decode")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tendril.llm import bpe

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


from tendril.llm import chat, reputation  # noqa: E402


@query("op2_url_reputation", reputation.oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are the outcomes of the pages with the same number: bad is low quality or toxic."""
    from pyspark.sql import functions as F

    labels = table(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return reputation.judge(table(spark, sf_dir, "pages"), outcomes, reputation.RULES)


@query("op3_chat_prefix_tree", chat.oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.with_extra(table(spark, sf_dir, "conversations")))


from tendril.llm import topk  # noqa: E402


@query("op9_exact_top_k", topk.oracle())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


from tendril.llm import secrets  # noqa: E402


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


from tendril.llm import decontaminate  # noqa: E402


@query("op7_benchmark_leaks")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


from tendril.llm import language  # noqa: E402


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


from tendril.llm import passages, substrings  # noqa: E402


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


@query("op6_fm_index_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(table(spark, sf_dir, "documents"))


from tendril.llm import jaccard  # noqa: E402


@query("op5_chosen_path_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes_of(table(spark, sf_dir, "documents"))


from tendril.llm import kneser_ney  # noqa: E402


@query("op11_kneser_ney_score")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.digest(table(spark, sf_dir, "documents"))


from tendril.llm import negatives  # noqa: E402


@query("op13_hard_negatives", negatives.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), label=negatives.relabelled())


from tendril.llm import spelling  # noqa: E402


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


import corpus_pipeline  # noqa: E402

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)