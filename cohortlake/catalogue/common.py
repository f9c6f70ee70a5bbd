"""Helpers shared by the query modules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlake.operators import daily as D
from cohortlake.plans import labels as L
from cohortlake.sources import standin as V

DIGITS = 6
# Averages of cents often end in an exact half of the last digit, where the last bit would decide the rounding.
# Both sides shift by this hair before they round.
HAIR = 3.14159e-8


def rounded(df: DataFrame, digits: int = DIGITS, done: str = "^$") -> DataFrame:
    """Round every double, since sums depend on their order in the last bits; not those whose name ``done`` is found in."""

    def one(c: str, kind: str) -> Column:
        return F.round(F.col(f"`{c}`") + HAIR, digits).alias(c) if kind in ("double", "float") and not re.search(done, c) else F.col(f"`{c}`")

    return df.select(*[one(c, kind) for c, kind in df.dtypes])


def sql_rounded(cols: str | list[str], inner: str, digits: int = DIGITS) -> str:
    """Same rounding in SQL for the named columns; adding 0 turns -0.0 into 0.0."""
    names = cols.split() if isinstance(cols, str) else cols
    return f"SELECT * REPLACE ({', '.join(f'round({c} + {HAIR}::DOUBLE, {digits}) + 0 AS {c}' for c in names)}) FROM ({inner})"


def sql_offsets(c: str) -> str:
    nums = f"list_transform(string_split(coalesce({c}, ''), ','), lambda x: TRY_CAST(trim(x) AS DOUBLE))"
    return f"list_transform(list_filter({nums}, lambda x: x > -8 AND x <= -1), lambda x: CAST(trunc(x) AS INTEGER))"


def minutes(spark: SparkSession, d: str) -> DataFrame:
    return D.clean_minutes(V.raw_minutes(spark, d))


def minutes_a(spark: SparkSession, d: str) -> DataFrame:
    return D.add_activity(minutes(spark, d))


def label_tables(spark: SparkSession, d: str, thresholds=(2, 3, 4)) -> L.LabelTables:
    return L.build_labels(V.weekly(spark, d), V.daily(spark, d), thresholds)


def event_weeks(spark: SparkSession, d: str) -> DataFrame:
    return L.weekly_events(V.weekly(spark, d))


def week_scores(spark: SparkSession, d: str) -> DataFrame:
    return L.scores_in_positive_weeks(L.daily_scores(V.daily(spark, d)), event_weeks(spark, d))


def probable_days(spark: SparkSession, d: str) -> DataFrame:
    """Probable days alone; where they have one reader nothing needs to be stored."""
    return L.probable_event_days(event_weeks(spark, d), week_scores(spark, d))


def episodes(spark: SparkSession, d: str) -> DataFrame:
    return L.episodes(probable_days(spark, d))


def daily_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "smartwatch": D.smartwatch_daily(minutes_a(spark, d)),
        "smartinhaler": D.inhaler_daily(V.inhaler(spark, d)),
        "peakflow": D.peakflow_daily(V.peakflow(spark, d), V.patient(spark, d)),
        "environment": D.environment_daily(V.environment(spark, d)),
    }
