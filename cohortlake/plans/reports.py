"""Result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortlake.functions import exprs as E
from cohortlake.operators import profile, select
from cohortlake.sources.tables import GRID_KEYS

HEADLINE = [
    "train_pr_auc", "val_pr_auc", "train_val_pr_auc_gap", "val_recall_at_precision_floor",
    "val_precision_at_recall_floor", "test_pr_auc", "val_test_pr_auc_gap", "test_roc_auc", "test_f1",
    "overfit_gap_flag", "low_val_event_detection_flag",
]


def seeded_families(runs: DataFrame, name: str) -> DataFrame:
    """Seed means of final rows per (name, grid cell) with the rate of overfit flags."""
    means = ["train_pr_auc", "val_pr_auc", "train_val_pr_auc_gap", "test_pr_auc", "val_test_pr_auc_gap", "test_roc_auc", "test_f1"]
    return runs.groupBy(name, *GRID_KEYS).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in means],
        F.stddev_samp("test_pr_auc").alias("test_pr_auc_std"),
        F.avg(F.col("overfit_gap_flag").cast("double")).alias("overfit_gap_rate"),
        F.count("seed").alias("n_seeds"),
    )


def headline(single: DataFrame, seeded: DataFrame | None = None, name: str = "algo") -> DataFrame:
    """Best single-run row per model plus the seed means of the multi-seed family."""
    top = select.best_trials(single, [name])
    first = top.select(
        F.lit("tabular").alias("family"), F.col(name).alias("name"), *GRID_KEYS,
        F.lit("val_pr_auc").alias("selection_metric"), *HEADLINE,
    )
    if seeded is None:
        return first
    agg = seeded_families(seeded, name)
    means = ["train_pr_auc", "val_pr_auc", "train_val_pr_auc_gap", "test_pr_auc", "val_test_pr_auc_gap", "test_roc_auc", "test_f1"]
    second = agg.select(
        F.lit("seeded").alias("family"), F.col(name).alias("name"), *GRID_KEYS,
        F.lit("val_pr_auc_mean").alias("selection_metric"), *[F.col(f"{m}_mean").alias(m) for m in means],
        "test_pr_auc_std", "overfit_gap_rate", "n_seeds",
    )
    return profile.union_present([first, second])


def experiment_ranking(parts: Sequence[DataFrame | None], baseline: tuple[str, float, float, int]) -> DataFrame:
    """Experiments with their gain over a locked baseline row, best first."""
    rows = profile.union_present(parts)
    spark = rows.sparkSession
    locked = spark.createDataFrame(
        [(baseline[0], "Baseline", baseline[1], baseline[2], baseline[3])],
        "experiment STRING, family STRING, roc_auc_mean DOUBLE, roc_auc_std DOUBLE, n_seeds BIGINT",
    )
    out = rows.unionByName(locked, allowMissingColumns=True)
    out = out.withColumn("delta_auc", F.round(F.col("roc_auc_mean") - baseline[1], 4))
    cols = ["roc_auc_mean", "roc_auc_std", "pr_auc_mean", "f1_mean"]
    return out.select(
        "experiment", "family", "delta_auc", "n_seeds", *[F.round(c, 4).alias(c) for c in cols if c in out.columns]
    ).orderBy(F.desc_nulls_last("roc_auc_mean"), "experiment")


def tier_headline(single: DataFrame | None, seeded: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """One row per model: the multi-seed result where there is one, else the single run."""
    if seeded is None or single is None:
        return profile.union_present([seeded, single])
    rest = single.join(seeded.select(*keys).distinct(), list(keys), "left_anti")
    return profile.union_present([seeded.withColumn("origin", F.lit("multi_seed")), rest.withColumn("origin", F.lit("single"))])


def listing(df: DataFrame, columns: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Projected and sorted result table; ``order`` holds (column, descending)."""
    return df.select(*columns).orderBy(*[F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in order])


def winners_with_intervals(winners: DataFrame, full: DataFrame, ci: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Winner rows with their full metrics and intervals; unmatched parts stay NULL."""
    keys = list(keys)
    return winners.join(full, keys, "left").join(ci, keys, "left")


def compare_with_reported(new: DataFrame, reported: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    a = new.select(key, *[F.col(m).alias(f"{m}_new") for m in metrics])
    b = reported.select(key, *[F.col(m).alias(f"{m}_reported") for m in metrics])
    return a.join(b, key).withColumns({f"{m}_diff": F.col(f"{m}_new") - F.col(f"{m}_reported") for m in metrics})


def formatted(df: DataFrame, mean: str, std: str) -> DataFrame:
    return df.withColumns({"auc_text": E.mean_pm_std(mean, std), "mean_text": E.report_number(mean)})
