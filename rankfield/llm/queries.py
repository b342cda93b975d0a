"""Registered queries of this package, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    curriculum,
    decontaminate,
    langid,
    near,
    packing,
    periods,
    runlength_index,
    secrets,
    sentence_spans,
    token_links,
    topk,
    toxicity,
)
from .staging import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.remove_repeated_spans(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.drop("key")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("toxic", (F.col("p_toxic") >= model.reject) & (F.col("n_features") > 0))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_runlength_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlength_index.remove_repeated_bytes(documents(spark, sf_dir))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.derived_calls(_table(spark, sf_dir, "conversations"))
    return chat.link_tool_calls(calls, results, chat.TOOLS)


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.periodic_runs(documents(spark, sf_dir), periods.periodic_tail))


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.digests(token_links.token_links(documents(spark, sf_dir)))


def op13_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.taken_words(curriculum.mix(documents(spark, sf_dir))).drop("first_position")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentence_spans,
        op2_decontamination,
        op3_top_k,
        op4_secret_scan,
        op5_toxicity,
        op6_packing,
        op7_runlength_index,
        op8_near_dedup,
        op9_language,
        op10_tool_calls,
        op11_periods,
        op12_token_links,
        op13_curriculum,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontaminate.SQL,
    "op3_top_k": topk.SQL,
    "op10_tool_calls": chat.SQL,
    "op13_curriculum": curriculum.SQL,
}
