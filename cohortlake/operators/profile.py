"""Table and column profiles. Every profile is one or two grouped passes over the table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.operators.ordering import exact_quantiles


def column_profile(df: DataFrame) -> DataFrame:
    """Type, missing count and share, and distinct values of every column.

    Values are laid out long and distinct (column, value) pairs are counted, so each column's distinct
    count is spread over tasks instead of being one wide expand.
    """
    kinds = dict(df.dtypes)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "v")
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    missing = F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0))
    from cohortlake.functions.exprs import lookup

    return counts.groupBy("column").agg(
        missing.alias("missing_count"),
        (missing / F.sum("n") * 100).alias("missing_pct"),
        F.count("v").alias("n_unique"),
    ).withColumn("dtype", lookup(F.col("column"), kinds))


def user_profile(df: DataFrame, user: str, day: str, missing_of: str) -> DataFrame:
    return df.groupBy(user).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.countDistinct(day).alias("days"),
        (F.max(day) - F.min(day) + 1).alias("span_days"),
        (F.avg(F.col(missing_of).isNull().cast("int")) * 100).alias("missing_pct"),
    )


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles, max and missing share per column, one row each."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    v = F.col("value")
    basic = long.groupBy("column").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), (F.avg(v.isNull().cast("int")) * 100).alias("missing_pct"),
    )
    quart = exact_quantiles(long, ["column"], "value", {"q25": 0.25, "q50": 0.50, "q75": 0.75})
    return basic.join(quart, "column", "left")


def value_share(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("pct", F.col("count") / total * 100)


def missing_share(df: DataFrame) -> DataFrame:
    one = df.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in df.columns])
    return one.unpivot([], one.columns, "column", "missing_pct")


def quality_counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Named violation counts, plus rows that repeat an earlier row (count minus distinct count)."""
    out = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    grouped = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    dup = grouped.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).scalar()
    out = out.withColumn("duplicate_rows", dup)
    return out.unpivot([], out.columns, "metric", "value")


def flag_audit(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Count and share of every flag, long form."""
    one = df.agg(*[F.sum(F.col(f).cast("int")).alias(f) for f in flags])
    total = df.agg(F.count(F.lit(1))).scalar()
    return one.unpivot([], one.columns, "flag", "count").withColumn("pct", F.col("count") / total * 100)


def flag_correlations(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(flags) for b in flags[i + 1 :]]
    num = {f: F.col(f).cast("double") for f in flags}

    def corr(x: Column, y: Column) -> Column:
        # The built-in corr divides by zero for a constant flag.
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    one = df.agg(*[corr(num[a], num[b]).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], one.columns, "pair", "corr")
    names = F.split("pair", r"\|")
    return long.select(names[0].alias("flag_a"), names[1].alias("flag_b"), "corr")


def rule_sweep(df: DataFrame, rules: dict[str, Column], user: str) -> DataFrame:
    """Positives, rate and users with positives per candidate rule, all rules in one pass."""
    per_user = df.groupBy(user).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]
    )
    total = per_user.agg(F.sum("_n")).scalar()
    long = per_user.unpivot([user], list(rules), "rule", "hits")
    return long.groupBy("rule").agg(
        F.sum("hits").alias("positives"), F.count_if(F.col("hits") > 0).alias("users_with_positives")
    ).withColumn("rate", F.col("positives") / total)


def user_rates(df: DataFrame, user: str, target: str) -> DataFrame:
    return df.groupBy(user).agg(F.avg(target).alias("positive_rate"), F.count(F.lit(1)).alias("n"))


def union_present(parts: Sequence[DataFrame | None]) -> DataFrame:
    """Union of the parts that exist, with NULL for columns a part lacks."""
    found = [p for p in parts if p is not None]
    if not found:
        raise ValueError("no table to combine")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
