"""Row-ordered windows over keys of any size.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task. That is the best plan while every key is
small, and the wrong one when a single city holds a third of the table. Each function here first counts the rows per
key (one narrow, pre-aggregated job). While the largest key is within ``limit`` the plain window is used. Beyond it
the rows are range-partitioned by key and order, which splits a large key at will, written out once, and numbered
from the partition counts. The windows then run inside chunks of ``limit`` rows, each with what it needs from the
chunks before: the last few rows (``chunk_windows``) or a summary (``chunk_carry``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from zephyra.plans.tables import write_out

ROWS_PER_TASK = 4_000_000


def largest_key(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest key, and of the whole table. One row reaches the driver."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("top"), F.sum("count").alias("total")).first()
    return row["top"] or 0, row["total"] or 0


def same_keys(left: str, right: str, names: list[str]) -> Column:
    """Null-safe equality, so that a null key is a key like any other."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def join_on(left: DataFrame, right: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """Null-safe join that keeps the key columns of the left side once."""
    extra = [F.col(f"r.{c}") for c in right.columns if c not in names]
    return left.alias("l").join(right.alias("r"), same_keys("l", "r", names), how).select("l.*", *extra)


def number_rows(df: DataFrame, keys: list[str], order: list[str], partitions: int) -> DataFrame:
    """Add ``_row``, the position of each row within its key, counted from 0, without a large sort in one task.

    ``order`` must be unique within a key, or equal rows are numbered in any order.
    """
    placed = write_out(
        df.repartitionByRange(partitions, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_place", 33))
    parts = placed.groupBy(*keys, "_part").agg(F.min("_place").alias("_low"), F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys, "_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_low")).alias("_shift")
    )
    numbered = join_on(placed, parts, [*keys, "_part"], "inner")
    return numbered.withColumn("_row", F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift")


def chunk_rows(
    df: DataFrame, keys: list[str], order: list[str], limit: int, bound: DataFrame | None = None
) -> DataFrame | None:
    """``df`` with ``_row`` and ``_chunk`` (``limit`` rows each), or None while no key exceeds ``limit``.

    ``bound`` is a table that is cheaper to count and holds at least the rows of ``df``, such as the input of the steps
    that lead to ``df``.
    """
    if bound is not None and largest_key(bound, keys)[0] <= limit:
        return None
    top, total = largest_key(df, keys)
    if top <= limit:
        return None
    partitions = max(2, -(-total // limit))
    rows = number_rows(df, keys, order, partitions)
    return rows.withColumn("_chunk", F.expr(f"_row div {limit}"))


def row_windows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    make: Callable[[WindowSpec], list[Column]],
    reach: int,
    limit: int = ROWS_PER_TASK,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Add the columns of ``make(window)``, whose frames look at most ``reach`` rows back and none ahead."""
    limit = max(limit, reach)
    chunks = chunk_rows(df, keys, order, limit, bound)
    if chunks is None:
        return df.select("*", *make(Window.partitionBy(*keys).orderBy(*order)))
    return chunk_windows(chunks, keys, make, reach, limit).drop("_row", "_chunk")


def chunk_windows(
    chunks: DataFrame, keys: list[str], make: Callable[[WindowSpec], list[Column]], reach: int, limit: int
) -> DataFrame:
    """The same inside chunks: the last ``reach`` rows of a chunk are copied to the next one, and dropped after."""

    def copy(at: Column, own: bool) -> Column:
        return F.struct(at.alias("_at"), F.lit(own).alias("_own"))

    here = copy(F.col("_chunk"), True)
    copies = F.when(
        F.col("_row") % limit >= limit - reach, F.array(here, copy(F.col("_chunk") + 1, False))
    ).otherwise(F.array(here))
    window = Window.partitionBy(*keys, "_at").orderBy("_row")
    made = chunks.select("*", F.inline(copies)).select("*", *make(window))
    return made.where("_own").drop("_at", "_own")


def chunk_carry(chunks: DataFrame, keys: list[str], parts: list[Column], merge: Callable) -> DataFrame:
    """Per key and chunk, what the other chunks of the key hold.

    ``parts`` are aggregates of one chunk. ``merge(before, whole)`` gives the columns to keep, from a frame over the
    chunks before this one and a frame over all chunks of the key. The summary has one row per chunk.
    """
    summary = chunks.groupBy(*keys, "_chunk").agg(*parts)
    ordered = Window.partitionBy(*keys).orderBy("_chunk")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return summary.select(*keys, "_chunk", *merge(before, whole))


def running_max_before(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    name: str,
    limit: int = ROWS_PER_TASK,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Add the largest ``value`` among the earlier rows of the key."""
    chunks = chunk_rows(df, keys, order, limit, bound)
    if chunks is None:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.max(value).over(window))
    carried = chunk_carry(
        chunks, keys, [F.max(value).alias("_top")], lambda before, _: [F.max("_top").over(before).alias("_carried")]
    )
    window = Window.partitionBy(*keys, "_chunk").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = join_on(chunks, carried, [*keys, "_chunk"])
    made = rows.withColumn(name, F.greatest(F.max(value).over(window), "_carried"))
    return made.drop("_row", "_chunk", "_carried")


def fill_forward_then_back(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
    default: dict[str, object],
    limit: int | None = ROWS_PER_TASK,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Replace nulls by the last known value, before the first known value by that, and else by ``default``.

    After the forward step only the rows before the first known value are empty, and the backward step gives all of
    them that one value, so no backward frame is needed. ``limit=None`` says that no key is large.
    """
    chunks = None if limit is None else chunk_rows(df, keys, order, limit, bound)
    if chunks is not None:
        return fill_chunks(chunks, chunks, keys, columns, default).select(*df.columns)
    ordered = Window.partitionBy(*keys).orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = {
        c: [F.last(c, ignorenulls=True).over(so_far), F.first(c, ignorenulls=True).over(whole)] for c in columns
    }
    return _filled(df, found, default)


def fill_chunks(
    rows: DataFrame, chunks: DataFrame, keys: list[str], columns: list[str], default: dict[str, object]
) -> DataFrame:
    """The same inside chunks. ``rows`` are the chunks, possibly with more columns."""
    known = {c: F.when(F.col(c).isNotNull(), F.col("_row")) for c in columns}
    parts = [F.max_by(c, known[c]).alias(f"_last_{c}") for c in columns]
    parts += [F.min_by(c, known[c]).alias(f"_first_{c}") for c in columns]

    def merge(before: WindowSpec, whole: WindowSpec) -> list[Column]:
        return [F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_before_{c}") for c in columns] + [
            F.first(f"_first_{c}", ignorenulls=True).over(whole).alias(f"_whole_{c}") for c in columns
        ]

    joined = join_on(rows, chunk_carry(chunks, keys, parts, merge), [*keys, "_chunk"])
    so_far = Window.partitionBy(*keys, "_chunk").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    found = {
        c: [F.last(c, ignorenulls=True).over(so_far), F.col(f"_before_{c}"), F.col(f"_whole_{c}")] for c in columns
    }
    return _filled(joined, found, default).select(*rows.columns)


def _filled(df: DataFrame, found: dict[str, list[Column]], default: dict[str, object]) -> DataFrame:
    def column(c: str) -> Column:
        if c not in found:
            return F.col(c)
        last_resort = [F.lit(default[c])] if c in default else []
        return F.coalesce(*found[c], *last_resort).alias(c)

    return df.select(*map(column, df.columns))


def rows_at(
    df: DataFrame, order: list[str], positions: list[int], limit: int = ROWS_PER_TASK, total: int | None = None
) -> DataFrame:
    """The ``order`` values at the given positions of the whole table, as ``_row`` and the order columns.

    Only the order columns are read and sorted. The answer has one row per position.
    """
    narrow = df.select(*order)
    total = narrow.count() if total is None else total
    if total <= limit:
        numbered = narrow.withColumn("_row", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    else:
        numbered = number_rows(narrow, [], order, max(2, -(-total // limit)))
    return numbered.where(F.col("_row").isin(positions)).select("_row", *order)
