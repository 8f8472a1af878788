"""Shards whose sources are mixed in proportion: stratified interleaving by fractional rank.

Rows of a source are shuffled by a seeded hash and ranked; row r of n gets the fraction (r + 1/2) / n. Sorted by that
fraction every stretch of the whole order holds each source in proportion, so cutting it into equal stretches gives shards
that match the mixture. Shard sizes in rows differ by one at most.

Ranks over a source or over the whole table would be one task each. Here rows fall into many buckets that follow the order;
a rank is the number of rows in earlier buckets, from pre-aggregated counts, plus the place within the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket holds on average. It bounds what one group sorts; results do not depend on it.
ROWS_PER_BUCKET = 1024
_COARSE = 4096


def _starts(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Adds ``_start``, the rows in earlier buckets of the same ``by``. Summed in two levels, so that no window grows
    with the number of buckets."""
    counts = counts.withColumn("_coarse", F.floor(F.col(bucket) / _COARSE))
    fine = Window.partitionBy(*by, "_coarse").orderBy(bucket)
    coarse = counts.groupBy(*by, "_coarse").agg(F.sum("_n").alias("_sum"))
    wide = Window.partitionBy(*by).orderBy("_coarse")
    coarse = coarse.withColumn("_before", F.sum("_sum").over(wide) - F.col("_sum"))
    counts = counts.withColumn("_start", F.sum("_n").over(fine) - F.col("_n"))
    counts = counts.join(coarse.drop("_sum"), [*by, "_coarse"])
    return counts.withColumn("_start", F.col("_start") + F.col("_before")).drop("_coarse", "_before")


def _ranked(rows: DataFrame, by: list[str], bucket: str, order: list[Column | str], name: str) -> DataFrame:
    """Adds ``name``, the place of a row among those of the same ``by``, from 0."""
    counts = rows.groupBy(*by, bucket).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order)) - 1
    placed = rows.withColumn("_place", place).join(_starts(counts, by, bucket), [*by, bucket])
    return placed.withColumn(name, F.col("_start") + F.col("_place")).drop("_start", "_place", "_n", bucket)


def shards(
    docs: DataFrame, n_shards: int = 40, seed: int = 7, stratum: str = "source", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs(doc_id, text, stratum)``.

    The law is ``rows``: shard sizes differ by one row at most; ``grown_shard`` is null under it. A null text has size 16 and
    the checksum of the empty text. A null source is a source of its own, a null id is shuffled like any other value. Repeated
    rows each get a slot. Ties in the fraction go by shuffle hash, then by id. An empty table gives no rows; fewer rows
    than shards leave shards empty. Other columns are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("_stratum"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("_hash"),
    )
    total = docs.count()
    buckets = max(1, -(-total // rows_per_bucket))
    spread = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("_bucket", F.floor(spread * buckets))
    ranked = _ranked(rows, ["_stratum"], "_bucket", ["_hash", "doc_id"], "_rank")
    sizes = rows.groupBy("_stratum").agg(F.count("*").alias("_rows"))
    # the sources are few beside the rows; whichever way Spark joins them, a large source can be split
    placed = ranked.join(sizes, "_stratum")
    placed = placed.withColumn("_fraction", (2 * F.col("_rank") + 1) / (2 * F.col("_rows")))
    placed = placed.withColumn("_bucket", F.least(F.floor(F.col("_fraction") * buckets), F.lit(buckets - 1)))
    placed = _ranked(placed.drop("_rank", "_rows", "_stratum"), [], "_bucket", ["_fraction", "_hash", "doc_id"], "_at")
    shard = F.expr(f"((_at + 1) * {n_shards}L - 1) div {max(total, 1)}L")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_at") - F.expr(f"(shard * {max(total, 1)}L) div {n_shards}L")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
