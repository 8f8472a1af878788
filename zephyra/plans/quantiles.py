"""Exact quantiles of many columns, whatever their number of distinct values.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. It is used while ``rows * columns`` is
within ``limit``. Beyond that the values are counted once, cut into ranges of about equally many distinct values, and each
range learns from the counts of those before it which ranks it holds. No value, however large, widens a range: NaN and
infinity are values like others, NaN the largest. Both ways give linear interpolation between the two neighbouring ranks, and
a row for every group, column and probability, with NULL where there is no value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zephyra.functions.columns import long_rows
from zephyra.plans.ordered import join_on
from zephyra.plans.tables import write_out

VALUES_PER_AGGREGATE = 20_000_000
BROADCAST_ROWS = 1_000_000


def quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], keys: list[str] = (), limit: int = VALUES_PER_AGGREGATE
) -> DataFrame:
    """``keys..., feature, p, value``: the exact ``p``-quantile of the non-null values of each column."""
    keys = list(keys)
    if df.count() * len(columns) <= limit:
        return _built_in(df, columns, probabilities, keys)
    return _by_ranks(df, columns, probabilities, keys)


def _built_in(df: DataFrame, columns: list[str], probabilities: list[float], keys: list[str]) -> DataFrame:
    wanted = F.array(*map(F.lit, probabilities))
    wide = df.groupBy(*keys).agg(*[F.percentile(F.col(c).cast("double"), wanted).alias(c) for c in columns])
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.lit(p).alias("p"), F.get(F.col(c), F.lit(i)).alias("value"))
            for c in columns
            for i, p in enumerate(probabilities)
        ]
    )
    return wide.select(*keys, F.inline(entries))


def _small(bounds: DataFrame) -> DataFrame:
    """A few rows per column and key: broadcast when they are counted to be few. Otherwise they come from a written table,
    so that Spark may split a large key in the join."""
    written = write_out(bounds)
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def _by_ranks(df: DataFrame, columns: list[str], probabilities: list[float], keys: list[str]) -> DataFrame:
    group = [*keys, "feature"]
    values = long_rows(df, columns, *keys).where("value is not null")
    counted = values.groupBy(*group, "value").agg(F.count("*").alias("n"))
    # written where it was cut, so the number of its range stays with a row
    counted = write_out(counted.repartitionByRange(*group, "value").withColumn("part", F.spark_partition_id()))
    parts = counted.groupBy(*group, "part").agg(F.sum("n").alias("rows"))
    earlier = Window.partitionBy(*group).orderBy("part")
    parts = parts.withColumn("before", F.sum("rows").over(earlier) - F.col("rows"))
    sizes = parts.groupBy(*group).agg(F.sum("rows").alias("rows"))
    asked = sizes.withColumn("p", F.explode(F.array(*map(F.lit, probabilities))))
    asked = asked.select(*group, "p", (F.col("p") * (F.col("rows") - 1)).alias("at"))
    ranks = asked.select(*group, F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank")).distinct()
    # only ranges with a wanted rank are sorted
    held = join_on(ranks, _small(parts), group, "inner")
    held = held.where("rank >= before and rank < before + rows").select(*group, "part", "before", "rank")
    wanted = _small(held.select(*group, "part", "before").distinct())
    inside = join_on(counted, wanted, [*group, "part"], "inner")
    order = Window.partitionBy(*group, "part").orderBy("value")
    placed = inside.withColumn("start", F.col("before") + F.sum("n").over(order) - F.col("n"))
    found = join_on(held.drop("before"), placed.drop("before"), [*group, "part"], "inner")
    found = write_out(found.where("rank >= start and rank < start + n").select(*group, "rank", "value"))
    low = join_on(asked.withColumn("rank", F.floor("at")), found, [*group, "rank"], "inner").withColumnRenamed("value", "below")
    both = join_on(low.withColumn("rank", F.ceil("at")), found, [*group, "rank"], "inner")
    between = (F.ceil("at") - F.col("at")) * F.col("below") + (F.col("at") - F.floor("at")) * F.col("value")
    value = F.when(F.ceil("at") == F.floor("at"), F.col("below")).when(F.col("below") == F.col("value"), F.col("below"))
    answers = both.select(*group, "p", value.otherwise(between).alias("value"))
    whole = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    entries = [F.struct(F.lit(c).alias("feature"), F.lit(p).alias("p")) for c in columns for p in probabilities]
    return join_on(whole.select(*keys, F.inline(F.array(*entries))), answers, [*group, "p"], "left")
