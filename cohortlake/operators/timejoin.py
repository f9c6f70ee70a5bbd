"""Joins along time: nearest earlier or later row, rows inside intervals, dense calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortlake.functions.exprs import day_span


def nearest_row(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    *,
    forward: bool,
    strict: bool = True,
    per_column: bool = False,
    bucket: int | None = None,
) -> DataFrame:
    """Left join of each left row with the nearest later (or earlier) right row of the same ``by`` keys.

    Both sides shrink to their distinct times first, so repeated times never pile up in one task, and the
    match is joined back on (by, time). With ``bucket`` the times of one key are also cut into fixed spans:
    a match comes from the own span, or else from the nearest non-empty one. Leave it out only where the
    number of distinct times per key is small by nature (study days). With ``per_column`` every payload
    column takes its own nearest non-NULL value; otherwise the whole row is taken.
    """
    by = list(by)
    sign = -1 if forward else 1
    if per_column:
        fields = {c: F.col(c) for c in payload}
    else:
        fields = {"_row": F.struct(*[F.col(c) for c in payload])}
    span = F.floor(F.col("_t") / bucket) if bucket else F.lit(0)
    events = (
        right.filter(F.col(right_time).isNotNull())
        .select(*by, F.col(right_time).cast("bigint").alias("_t"), *[e.alias(n) for n, e in fields.items()])
        .groupBy(*by, "_t")
        .agg(*[F.min(n).alias(n) for n in fields])
        .withColumn("_b", span)
    )
    probes = left.select(*by, F.col(left_time).cast("bigint").alias("_t")).distinct().withColumn("_b", span)
    # On equal times a strict match must not see the right row: the probe sorts first.
    probe_rank, event_rank = (0, 1) if strict else (1, 0)
    mixed = probes.withColumn("_side", F.lit(probe_rank)).unionByName(
        events.withColumn("_side", F.lit(event_rank)), allowMissingColumns=True
    )
    near = W.partitionBy(*by, "_b").orderBy(F.col("_t") * sign, "_side").rowsBetween(W.unboundedPreceding, 0)
    found = mixed.select(
        *by, "_t", "_b", "_side", *[F.last(n, ignorenulls=True).over(near).alias(n) for n in fields]
    ).filter(F.col("_side") == probe_rank)
    if bucket:
        def edge(n: str) -> Column:
            seen = F.when(F.col(n).isNotNull(), F.col("_t"))
            return (F.min_by if forward else F.max_by)(n, seen).alias(n)

        heads = events.groupBy(*by, "_b").agg(*[edge(n) for n in fields])
        spans = probes.select(*by, "_b").distinct().join(heads, [*by, "_b"], "full")
        past = W.partitionBy(*by).orderBy(F.col("_b") * sign).rowsBetween(W.unboundedPreceding, -1)
        carry = spans.select(*by, "_b", *[F.last(n, ignorenulls=True).over(past).alias(f"{n}_carry") for n in fields])
        found = found.join(carry, [*by, "_b"], "left").select(
            *by, "_t", *[F.coalesce(F.col(n), F.col(f"{n}_carry")).alias(n) for n in fields]
        )
    else:
        found = found.select(*by, "_t", *fields)
    joined = left.withColumn("_t", F.col(left_time).cast("bigint")).join(found, [*by, "_t"], "left")
    values = [F.col(c) for c in payload] if per_column else [F.col(f"_row.{c}").alias(c) for c in payload]
    return joined.select(*[F.col(c) for c in left.columns], *values)


def rows_in_intervals(
    rows: DataFrame, intervals: DataFrame, by: Sequence[str], day: str, start: str, end: str
) -> DataFrame:
    """Rows whose day lies in an interval of the same key; a row in two intervals comes out twice.

    Intervals are short (days), so they are laid out by day and the join is an equi join on (key, day).
    """
    laid = intervals.withColumn(day, F.explode(day_span(start, end)))
    return rows.join(laid, [*by, day])


def count_overlaps(windows: DataFrame, spans: DataFrame, by: Sequence[str], window: tuple[str, str], span: tuple[str, str], name: str) -> DataFrame:
    """Windows with the number of spans of the same key that share a day with them; those that meet none drop out.

    Spans that overlap a window are those begun by its last day less those ended before its first day. Both numbers
    are running counts, looked up once per (key, day): neither windows nor spans are laid out by day.
    """
    (first, last), (start, end) = window, span
    real = spans.filter(F.col(start) <= F.col(end))
    so_far = W.partitionBy(*by).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)

    def running(day: str, count: str) -> DataFrame:
        days = real.groupBy(*by, F.col(day).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
        return days.select(*by, "_at", F.sum("_n").over(so_far).alias(count))

    asked = windows.filter(F.col(first) <= F.col(last))
    begun = nearest_row(asked, running(start, "_begun"), by, last, "_at", ["_begun"], forward=False, strict=False)
    ended = nearest_row(begun.filter("_begun > 0"), running(end, "_ended"), by, first, "_at", ["_ended"], forward=False)
    hits = F.col("_begun") - F.coalesce("_ended", F.lit(0))
    return ended.withColumn(name, hits).filter(F.col(name) > 0).drop("_begun", "_ended")


def lay_out_days(df: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    return df.withColumn(day, F.explode(day_span(start, end)))


def dense_calendar(windows: DataFrame, daily: DataFrame, by: Sequence[str], start: str, end: str, day: str) -> DataFrame:
    """Every day of every window, with the day's row or NULLs."""
    return lay_out_days(windows, start, end, day).join(daily, [*by, day], "left")
