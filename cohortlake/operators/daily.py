"""Cleaning of minute data and one row per (user, day) for every source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.functions import exprs as E
from cohortlake.operators.ordering import exact_quantiles, number_rows
from cohortlake.sources import schemas as S
from cohortlake.sources.tables import require_columns

USER, DATE = "user_key", "date"
KEYS = [USER, DATE]


def clean_minutes(raw: DataFrame) -> DataFrame:
    """Distinct rows from day 0 on, impossible readings nulled, study-relative clock added."""
    # Both filters read only columns of the distinct's key, so they run at the scan.
    return (
        raw.filter((F.col(DATE) >= 0) & E.is_time("time"))
        .dropDuplicates()
        .withColumns(
            {
                "steps": F.when(F.col("steps") >= 0, F.col("steps")),
                "hr": F.when((F.col("hr") > 0) & ~F.isnan("hr"), F.col("hr")),  # NaN compares as the largest number
                "minutes_from_midnight": E.minute_of_day("time"),
            }
        )
        .withColumn("relative_minute", F.col(DATE) * E.DAY_MINUTES + F.col("minutes_from_midnight"))
    )


def add_activity(minutes: DataFrame) -> DataFrame:
    group = E.activity_group("activity_type")
    return minutes.withColumns(
        {
            "activity_group": group,
            "is_active_minute": group.isin(*E.ACTIVE_GROUPS).cast("int"),
            "is_day": E.is_daytime("minutes_from_midnight").cast("int"),
        }
    )


def cleaning_log(minutes: DataFrame) -> DataFrame:
    def missing(c: str) -> Column:
        return F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 2)

    one = minutes.agg(
        F.count(F.lit(1)).cast("double").alias("rows_after_cleaning"),
        F.countDistinct(USER).cast("double").alias("unique_users"),
        missing("hr").alias("missing_hr_pct"),
        missing("steps").alias("missing_steps_pct"),
    )
    return one.unpivot([], one.columns, "metric", "value")


def valid_days(df: DataFrame) -> DataFrame:
    """Rows with a user and a numeric day from 0 on, both as integers."""
    day = E.numeric(DATE)
    return df.filter(F.col(USER).isNotNull() & (day >= 0)).withColumn(DATE, day.cast("int"))


def _valid_hours(df: DataFrame) -> DataFrame:
    hour = E.numeric("hour")
    return valid_days(df).withColumn("hour", hour.cast("int")).filter(hour.between(0, 23))


def sum0(c: Column | str) -> Column:
    """Sum that is 0 for an all-NULL group."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def smartwatch_core(minutes_a: DataFrame) -> DataFrame:
    """Counts, heart rate, steps, intensity and coverage per day."""
    out = minutes_a.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("smartwatch_rows"),
        F.countDistinct("relative_minute").alias("smartwatch_observed_minutes"),
        F.count("hr").alias("smartwatch_hr_count"),
        F.avg("hr").alias("smartwatch_hr_mean"),
        F.stddev_samp("hr").alias("smartwatch_hr_std"),
        F.min("hr").alias("smartwatch_hr_min"),
        F.max("hr").alias("smartwatch_hr_max"),
        sum0("steps").alias("smartwatch_steps_sum"),
        F.avg("steps").alias("smartwatch_steps_mean"),
        F.max("steps").alias("smartwatch_steps_max"),
        F.avg("intensity").alias("smartwatch_intensity_mean"),
        F.stddev_samp("intensity").alias("smartwatch_intensity_std"),
        F.max("intensity").alias("smartwatch_intensity_max"),
        F.avg("is_active_minute").alias("smartwatch_active_minute_frac"),
        *_group_fractions("smartwatch_activity_frac_"),
        *_day_parts(),
    )
    minutes = float(E.DAY_MINUTES)
    return out.withColumns(
        {
            "smartwatch_day_coverage": E.clip(F.col("smartwatch_observed_minutes") / minutes, upper=1.0),
            "smartwatch_hr_missing_pct": E.clip(1 - F.col("smartwatch_hr_count") / minutes, 0.0, 1.0),
        }
    )


def _group_fractions(prefix: str) -> list[Column]:
    return [F.avg((F.col("activity_group") == g).cast("int")).alias(f"{prefix}{g}") for g in E.ACTIVITY_GROUPS]


def _day_parts() -> list[Column]:
    out = []
    for part, flag in (("day", 1), ("night", 0)):
        inside = F.col("is_day") == flag
        rows = F.count_if(inside)
        out += [
            F.avg(F.when(inside, F.col("hr"))).alias(f"smartwatch_{part}_hr_mean"),
            F.when(rows > 0, sum0(F.when(inside, F.col("steps")))).alias(f"smartwatch_{part}_steps_sum"),
            F.avg(F.when(inside, F.col("is_active_minute"))).alias(f"smartwatch_{part}_active_frac"),
        ]
    return out


def smartwatch_daily(minutes_a: DataFrame) -> DataFrame:
    """All smartwatch day features. The median is ranked apart, so that no day needs one task."""
    medians = exact_quantiles(minutes_a, KEYS, "hr", {"smartwatch_hr_median": 0.5})
    return smartwatch_core(minutes_a).join(medians, KEYS, "left")


def inhaler_daily(inhaler: DataFrame) -> DataFrame:
    require_columns(inhaler, [USER, DATE, "hour", "name"], "inhaler log")
    return (
        _valid_hours(inhaler)
        .groupBy(*KEYS)
        .agg(
            F.count(F.lit(1)).alias("smartinhaler_total_actuations"),
            F.countDistinct("name").alias("smartinhaler_unique_medications"),
            F.count_if(F.col("hour").between(0, 5)).alias("smartinhaler_night_early_actuations"),
            F.count_if(F.col("hour").between(18, 23)).alias("smartinhaler_evening_actuations"),
        )
        .withColumn("smartinhaler_active_day", F.lit(1))
    )


def peakflow_readings(peakflow: DataFrame, patient: DataFrame) -> DataFrame:
    """Valid readings with their share of the user's baseline."""
    base = patient.select(
        USER, F.coalesce(E.numeric("pef_best"), E.numeric("max_pef_expected")).alias("pef_baseline")
    )
    return (
        _valid_hours(peakflow)
        .withColumn("pef_max", E.numeric("pef_max"))
        .filter(F.col("pef_max") > 0)
        .join(base, USER, "left")
        .withColumns(
            {
                "peakflow_pef_pct_baseline": E.ratio("pef_max", "pef_baseline"),
                "morning": F.coalesce("morning", F.lit(True)),
            }
        )
    )


def peakflow_daily(peakflow: DataFrame, patient: DataFrame) -> DataFrame:
    pef, pct = F.col("pef_max"), F.col("peakflow_pef_pct_baseline")
    aggs = [
        F.count(pef).alias("peakflow_measurement_count"),
        F.avg(pef).alias("peakflow_pef_mean"),
        F.stddev_samp(pef).alias("peakflow_pef_std"),
        F.min(pef).alias("peakflow_pef_min"),
        F.max(pef).alias("peakflow_pef_max"),
        F.avg(pct).alias("peakflow_pct_baseline_mean"),
        F.min(pct).alias("peakflow_pct_baseline_min"),
        F.max(pct).alias("peakflow_pct_baseline_max"),
    ]
    for part, inside in (("morning", F.col("morning")), ("evening", ~F.col("morning"))):
        value = F.when(inside, pef)
        aggs += [
            F.when(F.count_if(inside) > 0, F.count(value)).alias(f"peakflow_{part}_count"),
            F.avg(value).alias(f"peakflow_{part}_pef_mean"),
            F.max(value).alias(f"peakflow_{part}_pef_max"),
        ]
    return peakflow_readings(peakflow, patient).groupBy(*KEYS).agg(*aggs)


def environment_daily(environment: DataFrame) -> DataFrame:
    levels = {f"{c}_level": E.pollen_level(c) for c in S.POLLEN_COLUMNS}
    cols = [*S.ENVIRONMENT_NUMERIC, *levels]
    out = (
        valid_days(environment)
        .withColumns(levels)
        .groupBy(*KEYS)
        .agg(*[F.avg(E.numeric(c)).alias(f"environment_{c}") for c in cols])
    )
    return out.withColumns(
        {
            f"environment_{c}_high": F.coalesce(F.col(f"environment_{c}") >= 3, F.lit(False)).cast("int")
            for c in levels
        }
    )


def one_row_per_user(patient: DataFrame) -> DataFrame:
    """Keep one row per user by a total order over all columns, so the choice never depends on file order."""
    row = F.min(F.struct(*[F.col(c) for c in patient.columns])).alias("r")
    return patient.groupBy(USER).agg(row).select("r.*")


def category_values(df: DataFrame, column: str) -> list[str]:
    """Sorted categories of a column that is to become one column per category.

    A wide table must know its columns when it is planned, so this reads as many values as the result has columns.
    Where that is too wide, declare the categories that matter, or use ``category_vectors``.
    """
    found = df.select(F.col(column).cast("string").alias("v")).filter(F.col("v").isNotNull()).distinct()
    return sorted(r.v for r in found.toLocalIterator())


def category_vectors(patient: DataFrame, columns: Sequence[str] = tuple(S.PATIENT_CATEGORICAL)) -> tuple[DataFrame, DataFrame]:
    """One-hot in sparse form for any number of categories: (user, indices) and the dimension (column, value, index).

    Indices run from 0 over all columns in order of (column, value), the NULL category of a column last. Nothing is
    collected and no column is made per value.
    """
    one = one_row_per_user(patient)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns if c in patient.columns])
    long = one.select(USER, F.explode(pairs).alias("p")).select(USER, "p.*")
    missing, named = F.col("value").isNull(), F.coalesce("value", F.lit(""))
    values = long.select("column", "value", missing.alias("missing"), named.alias("named")).distinct()
    # Ranks within bands of hashed order would lose the order of values; the band is the value's first characters.
    band = F.concat(F.col("column"), F.lit(":"), F.col("missing").cast("int").cast("string"), F.lit(":"), F.substring("named", 1, 3))
    ranked = number_rows(values, [], [band], [F.col("column"), F.col("missing"), F.col("named")], "rn")
    dimension = ranked.select("column", "value", (F.col("rn") - 1).alias("index"))
    hit = (F.col("l.column") == F.col("d.column")) & F.col("l.value").eqNullSafe(F.col("d.value"))
    laid = long.alias("l").join(dimension.alias("d"), hit)
    return laid.groupBy(f"l.{USER}").agg(F.sort_array(F.collect_list("index")).alias("indices")), dimension


def patient_static(patient: DataFrame, categories: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Static block: numbers as they are, categories one-hot with an own column for NULL.

    ``categories`` declares the values of a column; other columns' values are read from the table.
    """
    declared = categories or {}
    one = one_row_per_user(patient)
    numeric = [c for c in S.PATIENT_NUMERIC if c in patient.columns]
    flags = []
    for c in (c for c in S.PATIENT_CATEGORICAL if c in patient.columns):
        flags += [
            F.coalesce(F.col(c) == v, F.lit(False)).cast("int").alias(f"patient_{c}_{v}")
            for v in declared.get(c) or category_values(patient, c)
        ]
        flags.append(F.col(c).isNull().cast("int").alias(f"patient_{c}_nan"))
    return one.select(USER, *[E.numeric(c).alias(f"patient_{c}") for c in numeric], *flags)
