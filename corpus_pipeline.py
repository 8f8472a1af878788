"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's documents.

Each stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of documents; the last returns token counts
and digests. Columns beside ``doc_id`` and ``text`` are carried through as they are, but for ``n_chars`` of a cut text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyra.llm import bpe, decontaminate, langid, neardup, repeats
from zephyra.plans.tables import write_out
from zephyra.session import configure


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is ``und`` go: those with a null text or without any letter. If no language can be learned, the
    others stay all the same."""
    model = langid.fit(langid.training_rows(docs), public_tokenizers.path("piece_bpe_32k.model"))
    if not model.languages:
        return docs.where(F.col("text").rlike(langid.LETTER))
    labelled = langid.predict(docs, model, carry=docs.columns)
    return labelled.where("lang_pred != 'und'").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays. Of rows with one id and one text one stays. Rows
    without id stay, as no other can be told to stand for them."""
    found = neardup.near_duplicates(docs)
    copies = found.where("doc_id != component_id").select("doc_id").distinct()
    kept = neardup.keyed(docs, copies, "doc_id", "left_anti")
    twice = write_out(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, "doc_id", "left_anti").unionByName(once)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of 50 bytes that an earlier document has are cut out of the texts; every document stays."""
    cut = repeats.removed(docs, carry=docs.columns)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    changed = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))
        changed["n_chars"] = length.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in docs.columns}
    return cut.select(*[changed.get(c, F.col(f"row.{quoted[c]}").alias(c)) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark, carry=docs.columns)
    return found.where("not contaminated").select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as counts and digests, with the digest of the decoded bytes."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(docs, path, pattern, with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Language models and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
