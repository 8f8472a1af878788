"""One query per operator of this package over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from zephyra.llm import (
    archives,
    bpe,
    decontaminate,
    langid,
    neardup,
    repeats,
    search,
    sharding,
    tokencount,
    tokenfiles,
    topk,
    toxicity,
    whitening,
)
from zephyra.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(spark, folder, "documents"))


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("span_starts", "span_ends")


@query
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(table(spark, folder, "documents"), path, pattern, with_ids=False)


@query
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.removed(table(spark, folder, "documents"))


@query
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archives.archive(table(spark, folder, "pages"))


@query
def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.by_component(*whitening.whiten(table(spark, folder, "embeddings")))


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfiles.token_files(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
