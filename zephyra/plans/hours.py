"""Trailing time windows and as-of lags in near-linear time.

A RANGE frame of 24 hours costs each row a pass over a day of rows, and its partition is a whole city. Here the time
line of a key is cut into hours. The frame that ends at ``t`` and starts ``n`` hours earlier begins at the same offset
inside an earlier hour, so it consists of

* the rows of the hour of ``t`` before ``t``            (a running aggregate inside that hour),
* the full hours in between, at most 23 small summaries  (a frame over the hours),
* the rows of the earlier hour after the offset          (a running aggregate from the end of that hour).

Rows of one instant are combined before the first shuffle. A busy city is spread over as many tasks as it has hours, and an
hour that holds more than ``limit`` of them is cut further: at any offset, into chunks of about ``limit`` rows. A chunk
runs its own aggregates, and a summary for each chunk says what the chunks before and after it in the hour hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.plans.ordered import ROWS_PER_TASK, chunk_carry, chunk_rows
from zephyra.plans.tables import write_out

#: Up to so many crowded instants are broadcast.
BROADCAST_INSTANTS = 1_000_000

#: Rows and questions to a task. Beyond the default number of partitions, the sorts get as many tasks as this asks for.
QUESTIONS_PER_TASK = 500_000

HOUR = 3_600_000_000  # microseconds

STATS = ("n", "mean", "m2", "lo", "hi")
_MOMENTS = {
    "n": "count(_value)", "mean": "avg(_value)", "m2": "var_pop(_value) * count(_value)", "lo": "min(_value)", "hi": "max(_value)"
}
RESULTS = ("count", "mean", "std", "min", "max")


def plain_keys(df: DataFrame, keys: list[str]) -> list[Column]:
    """Each key as a value and a flag for NULL, so that plain joins, which keep a partitioning, match null keys too."""
    made = []
    for i, name in enumerate(keys):
        kind = df.schema[name].dataType
        column = F.col(name) if isinstance(kind, (T.StringType, T.NumericType)) else F.col(name).cast("string")
        instead = F.lit(0) if isinstance(kind, T.NumericType) else F.lit("")
        made += [F.coalesce(column, instead).alias(f"_k{i}"), F.col(name).isNull().alias(f"_z{i}")]
    return made


def key_names(keys: list[str]) -> list[str]:
    return [f"_{kind}{i}" for i in range(len(keys)) for kind in "kz"]


def _hour_parts(us: str) -> list[Column]:
    return [F.expr(f"({us} - pmod({us}, {HOUR}L)) div {HOUR}L").alias("_hour"), F.expr(f"pmod({us}, {HOUR}L)").alias("_off")]


def _hour_table(points: DataFrame, keys: list[str], back: list[int], lags: list[int], windows: list[int]) -> DataFrame:
    """One row per key and hour that is looked at: its mean, the pooled hours before it, the last value before it."""
    parts = dict(_MOMENTS)
    if lags:
        parts["last"] = "max_by(_value, CASE WHEN _value IS NOT NULL THEN struct(_us, _tie) END)"
    own = points.groupBy(*keys, "_hour").agg(*[F.expr(f"{made} AS {name}") for name, made in parts.items()])
    asked = own.select("*", F.explode(F.array(*map(F.lit, [0, *back]))).alias("_back"))
    table = asked.groupBy(*keys, (F.col("_hour") - F.col("_back")).alias("_hour")).agg(
        *[F.expr(f"max(CASE WHEN _back = 0 THEN {c} END) AS {c}") for c in parts]
    )
    by_hour = f"PARTITION BY {', '.join(keys)} ORDER BY _hour"
    columns = [*keys, "_hour", "coalesce(mean, 0D) AS _center"]
    if lags:
        before = f"OVER ({by_hour} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        columns.append(f"last(last, true) {before} AS _last_before")

    def within(w: int) -> str:
        return f"OVER ({by_hour} RANGE BETWEEN {w - 1} PRECEDING AND 1 PRECEDING)"

    for w in windows:
        full = {f"n{w}": "sum(n)", f"sum{w}": "sum(n * mean)", f"lo{w}": "min(lo)", f"hi{w}": "max(hi)"}
        columns += [f"{made} {within(w)} AS {name}" if w > 1 else f"{_none(made)} AS {name}" for name, made in full.items()]
    if windows:
        piece = "CASE WHEN n > 0 THEN struct(_hour, n, mean, m2) END"
        widest = max(windows)
        nothing = "CAST(array() AS array<struct<_hour:bigint,n:bigint,mean:double,m2:double>>)"
        columns.append(f"collect_list({piece}) {within(widest)} AS _near" if widest > 1 else f"{nothing} AS _near")
    table = table.selectExpr(*columns)
    if not windows:
        return table.select(*keys, "_hour", "_center", "_last_before")
    table = table.selectExpr("*", *[f"try_divide(sum{w}, n{w}) AS mean{w}" for w in windows])
    # squares about the mean of the frame, which is only known now: a pass over the (at most 23) hours
    full = [
        f"named_struct('n', n{w}, 'mean', mean{w}, 'm2', {_spread('_near', w)}, 'lo', lo{w}, 'hi', hi{w}) AS full{w}" for w in windows
    ]
    kept = [*keys, "_hour", "_center", *(["_last_before"] if lags else [])]
    return table.selectExpr(*kept, *full).select(*kept, F.struct(*[f"full{w}" for w in windows]).alias("_full"))


def _none(made: str) -> str:
    """What an aggregate over no rows gives, in its type."""
    return "CAST(NULL AS bigint)" if made == "sum(n)" else "CAST(NULL AS double)"


def _spread(hours: str, w: int) -> str:
    gap = f"(x.mean - mean{w})"
    return f"aggregate({hours}, 0D, (t, x) -> CASE WHEN x._hour > _hour - {w} THEN t + x.m2 + x.n * {gap} * {gap} ELSE t END)"


def trailing(
    df: DataFrame,
    keys: list[str],
    ts: str,
    value: str,
    tie: str,
    lags: list[int] = (),
    windows: list[int] = (),
    closed: str = "neither",
    std: str = "pop",
    limit: int = ROWS_PER_TASK,
    top: int | None = None,
) -> DataFrame:
    """Lags and trailing statistics for every distinct ``(keys, ts)`` of ``df``.

    Columns: those of :func:`plain_keys`, ``_us`` (the instant in microseconds), ``lag_<n>`` for each lag (the value of
    the latest row at or before ``ts - n`` hours, the highest ``tie`` among rows of one instant) and ``count_<n>, mean_<n>, std_<n>, min_<n>, max_<n>`` for each window.
    Null values are skipped. ``closed`` says which ends of the frame belong to it: ``neither``, ``both`` or ``right``.
    ``top`` is :func:`largest_hour` if it is known already.
    """
    if closed not in ("neither", "both", "right"):
        raise ValueError(f"unknown closed: {closed}")
    if std not in ("pop", "samp"):
        raise ValueError(f"unknown std: {std}")
    lags, windows = sorted(set(lags)), sorted(set(windows))
    back = sorted(set(lags) | set(windows))
    if not back:
        raise ValueError("give lags or windows")
    names = list(keys)
    points = df.where(F.col(ts).isNotNull()).select(
        *plain_keys(df, keys),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"),
        F.col(value).cast("double").alias("_value"),
        F.col(tie).alias("_tie"),
    )
    keys = key_names(keys)
    points = points.select("*", *_hour_parts("_us"))
    last = "max_by(_value, CASE WHEN _value IS NOT NULL THEN _tie END)"
    instants = points.groupBy(*keys, "_hour", "_off", "_us").agg(
        *[F.expr(f"{made} AS {name}") for name, made in {**_MOMENTS, "last": last}.items()]
    )
    # every instant stands in its own hour, and as a question in the hours that its frames start in
    asked = instants.select("*", F.explode(F.array(*map(F.lit, [0, *back]))).alias("_back")).selectExpr(
        *keys, "_us", "_off", "_back", "_hour - _back AS _hour", *[f"CASE WHEN _back = 0 THEN {c} END AS {c}" for c in (*STATS, "last")]
    )
    table = _hour_table(points, keys, back, lags, windows)
    hour = [*keys, "_hour"]

    def edges(rows: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
        return _edges(rows, keys, windows, bool(lags), closed, chunks)

    tasks = _tasks(df, 1 + len(back))
    if tasks:  # the joins and windows over the hours keep this partitioning
        asked = asked.repartition(tasks, *hour)
    dense = None
    if (largest_hour(df, names, ts) if top is None else top) * (1 + len(back)) > limit:
        dense = _dense_hours(points, keys, back, limit)
    if dense is None:
        rows = edges(asked.join(table, hour))
    else:
        few = dense.count() <= BROADCAST_INSTANTS
        own = write_out(table.join(F.broadcast(dense) if few else dense, hour, "left_semi"))
        crowded = asked.join(F.broadcast(own) if few else own, hour)
        cut = chunk_rows(crowded.select(*hour, "_off").distinct(), hour, ["_off"], max(1, limit // (1 + len(back))))
        rest = asked.join(F.broadcast(dense) if few else dense, hour, "left_anti").join(table, hour)
        rows = edges(rest).unionByName(edges(crowded, cut))
    # bring the answers of an instant together; narrow rows travel, and they are put side by side afterwards
    rows = rows.repartition(tasks, *keys, "_us") if tasks else rows.repartition(*keys, "_us")

    def of(hours: int, column: str, name: str) -> Column:
        return F.expr(f"max(CASE WHEN _back = {hours} THEN {column} END) AS {name}")

    parts = [of(w, "_asof", f"lag_{w}") for w in lags]
    if windows:
        rows = rows.selectExpr("*", "_center + try_divide(e_s1, e_n) AS e_mean", "greatest(e_s2 - e_s1 * try_divide(e_s1, e_n), 0D) AS e_m2")
        for s in STATS:
            parts.append(of(0, f"e_{s}", f"head_{s}"))
            parts += [of(w, f"e_{s}", f"tail{w}_{s}") for w in windows]
            parts += [of(0, f"_full.full{w}.{s}", f"full{w}_{s}") for w in windows]
    found = rows.groupBy(*keys, "_us").agg(*parts)
    return _merged(found, keys, windows, std)


def _tasks(df: DataFrame, each: int) -> int | None:
    """Tasks for ``each`` times the rows of ``df``, or None where the default number of partitions is enough."""
    wanted = -(-df.count() * each // QUESTIONS_PER_TASK)
    return wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def largest_hour(df: DataFrame, keys: list[str], ts: str) -> int:
    """Rows of the fullest hour of a key. It shuffles one row per hour."""
    hour = F.expr(f"unix_micros(cast(`{ts}` as timestamp)) div {HOUR}L")
    return df.groupBy(*plain_keys(df, keys), hour.alias("_hour")).count().agg(F.max("count")).first()[0] or 0


def _dense_hours(points: DataFrame, keys: list[str], back: list[int], limit: int) -> DataFrame | None:
    """The hours that hold more than ``limit`` instants and questions, or None."""
    counts = points.groupBy(*keys, "_hour").agg(F.count_distinct("_off").alias("_n"))
    asked = counts.select("*", F.explode(F.array(*map(F.lit, [0, *back]))).alias("_back"))
    asked = asked.groupBy(*keys, (F.col("_hour") - F.col("_back")).alias("_hour")).agg(F.sum("_n").alias("_n"))
    dense = write_out(asked.where(F.col("_n") > limit).drop("_n"))
    return None if dense.isEmpty() else dense


def _edges(
    rows: DataFrame, keys: list[str], windows: list[int], lags: bool, closed: str, chunks: DataFrame | None
) -> DataFrame:
    """What the hour of a row holds before an instant, or after the start of a frame; and the last value there.

    ``chunks`` cuts hours: a chunk for each offset. Rows of one offset are never cut apart.
    """
    hour, cell = [*keys, "_hour"], [*keys, "_hour"]
    made = [*keys, "_us", "_back"]
    if windows:
        # sums about the mean of the hour, so that little cancels; the questions sort without the full hours
        sums = {"s1": "n * (mean - _center)", "s2": "m2 + n * (mean - _center) * (mean - _center)", "_full": "CASE WHEN _back = 0 THEN _full END"}
        kept = [c for c in rows.columns if c != "_full"]
        rows = rows.selectExpr(*kept, *[f"{made} AS {name}" for name, made in sums.items()])
        made += ["_center", "_full"]
    folds = {"n": "sum", "s1": "sum", "s2": "sum", "lo": "min", "hi": "max"} if windows else {}
    if chunks is not None:
        cell = [*hour, "_chunk"]
        rows = write_out(rows.join(chunks.drop("_row"), [*hour, "_off"]))
        parts = [F.expr(f"{fn}({c}) AS {c}") for c, fn in folds.items()]
        if lags:
            parts.append(F.expr("max_by(last, CASE WHEN last IS NOT NULL THEN struct(_off, _back) END) AS last"))
        after = Window.partitionBy(*hour).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)

        def others(before: WindowSpec, _: WindowSpec) -> list[Column]:
            sides = (("b", before), ("a", after))
            both = [getattr(F, fn)(c).over(w).alias(f"_{side}_{c}") for c, fn in folds.items() for side, w in sides]
            return both + ([F.last("last", ignorenulls=True).over(before).alias("_b_last")] if lags else [])

        rows = rows.join(chunk_carry(rows, hour, parts, others), cell)
    of = f"PARTITION BY {', '.join(cell)}"
    upto = "1 PRECEDING" if closed == "neither" else "CURRENT ROW"
    seen = f"OVER ({of} ORDER BY _off, _back ROWS BETWEEN UNBOUNDED PRECEDING AND {upto})"
    own_first = "_back" if closed == "both" else "_back DESC"
    later = f"OVER ({of} ORDER BY _off DESC, {own_first} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def with_others(found: str, side: str, column: str) -> str:
        if chunks is None:
            return found
        other = f"_{side}_{column}"
        if column in ("lo", "hi"):
            return f"{'least' if column == 'lo' else 'greatest'}({found}, {other})"
        return f"coalesce({found} + {other}, {found}, {other})"

    for column, fn in folds.items():
        head, tail = (with_others(f"{fn}({column}) {over}", side, column) for over, side in ((seen, "b"), (later, "a")))
        made.append(f"CASE WHEN _back = 0 THEN {head} ELSE {tail} END AS e_{column}")
    if lags:
        at_or_before = f"last(last, true) OVER ({of} ORDER BY _off, _back ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        made.append(f"coalesce({at_or_before}, {'_b_last, ' if chunks is not None else ''}_last_before) AS _asof")
    return rows.selectExpr(*made)


def _merged(found: DataFrame, keys: list[str], windows: list[int], std: str) -> DataFrame:
    """Put the three pieces of every window together: counts and means first, then the squares about the mean.

    As text, which Spark parses at once; there are hundreds of terms.
    """

    def known(w: int, s: str) -> list[str]:
        nothing = "0L" if s == "n" else "0D"
        return [f"coalesce({c}, {nothing})" for c in fields(w, s)]

    def fields(w: int, s: str) -> list[str]:
        return [f"tail{w}_{s}", f"full{w}_{s}", f"head_{s}"]

    def total(parts: list[str]) -> str:
        return "(" + " + ".join(parts) + ")"

    found = found.selectExpr("*", *[f"{total(known(w, 'n'))} AS count_{w}" for w in windows])
    means = []
    for w in windows:
        weighted = total([f"{n} * {m}" for n, m in zip(known(w, "n"), known(w, "mean"), strict=True)])
        means.append(f"try_divide({weighted}, count_{w}) AS mean_{w}")
        means.append(f"least({', '.join(fields(w, 'lo'))}) AS min_{w}")
        means.append(f"greatest({', '.join(fields(w, 'hi'))}) AS max_{w}")
    found = found.selectExpr("*", *means)
    deviations = []
    for w in windows:
        gaps = [f"({m} - mean_{w})" for m in known(w, "mean")]
        spread = total([f"{m2} + {n} * {g} * {g}" for m2, n, g in zip(known(w, "m2"), known(w, "n"), gaps, strict=True)])
        by = f"count_{w}" if std == "pop" else f"(count_{w} - 1)"
        inner = f"CASE WHEN min_{w} = max_{w} THEN 0D ELSE sqrt({spread} / {by}) END"
        deviations.append(f"CASE WHEN {by} > 0 THEN {inner} END AS std_{w}")
    found = found.selectExpr("*", *deviations)
    lags = [c for c in found.columns if c.startswith("lag_")]
    return found.select(*keys, "_us", *lags, *[f"{s}_{w}" for w in windows for s in RESULTS])


def add_trailing(
    df: DataFrame, keys: list[str], ts: str, tie: str, answers: DataFrame, *columns: Column, limit: int = ROWS_PER_TASK,
    top: int | None = None,
) -> DataFrame:
    """Give every row of ``df`` the ``columns`` of its instant, from the ``answers`` of :func:`trailing`.

    The answers are partitioned by key and instant already, so only ``df`` is shuffled. Instants with more than
    ``limit`` rows are spread over several tasks. ``top`` is :func:`largest_hour` if it is known already.
    """
    asked = df.select("*", *plain_keys(df, keys), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    on = [*key_names(keys), "_us"]
    found = answers.select(*on, *columns)
    names = found.columns[len(on) :]
    crowded = _crowded(asked, on, limit) if (largest_hour(df, keys, ts) if top is None else top) > limit else None
    if crowded is None:
        return asked.join(found, on, "left").select(*df.columns, *names)
    crowded = write_out(crowded)
    if crowded.count() <= BROADCAST_INSTANTS:  # else Spark joins them by a shuffle, in which it may split a large instant
        crowded = F.broadcast(crowded)
    share = F.pmod(F.xxhash64(tie), F.coalesce("_copies", F.lit(1)))
    asked = asked.join(crowded, on, "left").withColumn("_share", share)
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("_copies", F.lit(1).cast("long")) - 1)
    found = found.join(crowded, on, "left").select(*on, *names, F.explode(copies).alias("_share"))
    return asked.join(found, [*on, "_share"], "left").select(*df.columns, *names)


def _crowded(rows: DataFrame, on: list[str], limit: int) -> DataFrame | None:
    """The instants with more than ``limit`` rows and the number of tasks they need, or None."""
    crowded = rows.groupBy(*on).count().where(F.col("count") > limit)
    crowded = crowded.select(*on, F.ceil(F.col("count") / limit).alias("_copies"))
    return None if crowded.isEmpty() else crowded
