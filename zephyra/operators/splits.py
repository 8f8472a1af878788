"""Splits along time.

Only the rows at the cut positions are looked up (a sort of the order columns). They come back as a handful of
literals, and the table itself is split by comparing with them: no index column and no shuffle of whole rows. Rows without a
timestamp come before all others, in the order and in the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.plans.ordered import ROWS_PER_TASK, rows_at
from zephyra.schemas import CV_FOLDS


def _share(n_splits: int, test_size: float | None) -> float:
    if n_splits < 1:
        raise ValueError("n_splits must be at least 1")
    share = 1.0 / (n_splits + 1) if test_size is None else test_size
    if not 0 < share < 1:
        raise ValueError("test_size must be between 0 and 1")
    return share


class _Cuts:
    """Positions in time order, and a condition for "lies before this position"."""

    def __init__(self, df: DataFrame, order: list[str], positions: list[int], mode: str, limit: int, total: int):
        if mode not in ("rows", "time"):
            raise ValueError(f"unknown mode: {mode}")
        self.columns = [_sortable(df, name).alias(f"_o{i}") for i, name in enumerate(order)]
        names = [f"_o{i}" for i in range(len(order))]
        found = rows_at(df.select(*self.columns), names, sorted(set(positions)), limit, total).collect()
        self.rows = {row["_row"]: [row[name] for name in names] for row in found}
        self.columns = [_sortable(df, name) for name in (order if mode == "rows" else order[:1])]

    def before(self, position: int) -> Column:
        if position <= 0:
            return F.lit(False)
        if position not in self.rows:
            return F.lit(True)
        condition, equal = F.lit(False), F.lit(True)
        for column, value in zip(self.columns, self.rows[position]):
            less = F.lit(False) if value is None else column.isNull() | (column < F.lit(value))  # nulls sort first
            condition = condition | (equal & less)
            equal = equal & column.eqNullSafe(F.lit(value))
        return condition


def _sortable(df: DataFrame, name: str) -> Column:
    """Timestamps as microseconds, so that a value survives the way through Python unchanged."""
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name)


def expanding_folds(
    df: DataFrame,
    n_splits: int = CV_FOLDS,
    ts: str = "timestamp",
    tie: str = "seq",
    mode: str = "rows",
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """``fold, role`` and the columns of ``df``: fold ``i`` trains on the first ``i`` parts of ``n_splits + 1``, and
    tests on the next. ``(ts, tie)`` orders the rows. ``mode="time"`` moves every cut to the start of its timestamp.
    """
    _share(n_splits, None)
    total = df.count()
    size = total // (n_splits + 1)
    if size < 1:
        raise ValueError(f"{total} rows are not enough for {n_splits} splits")
    cuts = _Cuts(df, [ts, tie], [size * i for i in range(1, n_splits + 2)], mode, limit, total)
    entries = []
    for fold in range(1, n_splits + 1):
        role = F.when(cuts.before(size * fold), "train").when(cuts.before(size * (fold + 1)), "test")
        entries.append(F.struct(F.lit(fold).alias("fold"), role.alias("role")))
    return df.select(F.inline(F.array(*entries)), "*").where("role is not null")


def holdout_split(
    df: DataFrame,
    test_size: float | None = None,
    n_splits: int = CV_FOLDS,
    ts: str = "timestamp",
    tie: str = "seq",
    mode: str = "rows",
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``role``: the earliest rows ``train``, the latest ``test_size`` share ``test``."""
    share = _share(n_splits, test_size)
    total = df.count()
    if total == 0:
        raise ValueError("the table is empty")
    point = int(total * (1 - share))
    cuts = _Cuts(df, [ts, tie], [point], mode, limit, total)
    return df.withColumn("role", F.when(cuts.before(point), "train").otherwise("test"))


def leakage_check(split: DataFrame, ts: str = "timestamp") -> DataFrame:
    """``[fold,] max_train, min_test, no_leakage``: training ends strictly before testing starts."""
    keys = [c for c in ("fold",) if c in split.columns]
    ends = split.groupBy(*keys).agg(
        F.max(F.when(F.col("role") == "train", F.col(ts))).alias("max_train"),
        F.min(F.when(F.col("role") == "test", F.col(ts))).alias("min_test"),
    )
    return ends.withColumn("no_leakage", F.coalesce(F.col("max_train") < F.col("min_test"), F.lit(False)))
