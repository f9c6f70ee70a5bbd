"""Rule-based choice of the best trial and summaries of trial tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.functions import exprs as E


def diagnostics(trials: DataFrame, overfit_gap: float = 0.20, low_recall: float = 0.05) -> DataFrame:
    """Train-val and val-test gaps and the overfit and low-detection flags; absent columns count as NULL."""

    def c(name: str) -> Column:
        return E.numeric(name) if name in trials.columns else F.lit(None).cast("double")

    def keep(name: str, gap: Column) -> Column:
        return F.coalesce(gap, c(name))

    train_val = keep("train_val_pr_auc_gap", c("train_pr_auc") - c("val_pr_auc"))
    val_test = keep("val_test_pr_auc_gap", c("val_pr_auc") - c("test_pr_auc"))
    low = F.coalesce(c("val_recall") <= low_recall, F.lit(False)) | F.coalesce(c("val_f1") <= low_recall, F.lit(False))
    return trials.withColumns(
        {
            "train_val_pr_auc_gap": train_val,
            "val_test_pr_auc_gap": val_test,
            "overfit_gap_flag": F.coalesce(train_val > overfit_gap, F.lit(False)),
            "low_val_event_detection_flag": c("val_pr_auc").isNotNull() & low,
        }
    )


def _preference(score_col: str) -> list[tuple[str, bool]]:
    """Selection order: column and whether smaller is better."""
    prefix = score_col.removesuffix("pr_auc") if score_col.endswith("pr_auc") else "val_"
    simpler = ["selection_complexity", "representation_complexity", "model_complexity", "n_features", "n_channels"]
    return [
        (score_col, False),
        (f"{prefix}recall_at_precision_floor", False),
        ("train_val_pr_auc_gap", True),
        (f"{prefix}brier", True),
        *[(s, True) for s in simpler],
        ("val_roc_auc", False),
        ("val_f1", False),
    ]


def preference_key(df: DataFrame, score_col: str, tie_breaker: str) -> Column:
    """Struct whose minimum is the preferred row; a missing value ranks last, ties go to the smaller id."""
    fields, seen = [], set()
    for name, ascending in _preference(score_col):
        if name in df.columns and name not in seen:
            seen.add(name)
            x = E.numeric(name)
            fields.append(F.coalesce(x if ascending else -x, F.lit(float("inf"))).alias(name))
    return F.struct(*fields, F.col(tie_breaker).alias("_tie"))


def best_trials(trials: DataFrame, group: Sequence[str], score_col: str = "val_pr_auc", tie_breaker: str = "trial_id") -> DataFrame:
    """One winner per group. ``min_by`` keeps a partial winner per task, so no group is sorted whole."""
    if score_col not in trials.columns:
        raise KeyError(f"missing score column {score_col}")
    ranked = trials if "train_val_pr_auc_gap" in trials.columns else diagnostics(trials)
    row = F.struct(*[F.col(c) for c in ranked.columns])
    key = preference_key(ranked, score_col, tie_breaker)
    return ranked.groupBy(*group).agg(F.min_by(row, key).alias("_row")).select("_row.*")


def overall_best(trials: DataFrame, score_col: str = "val_pr_auc", tie_breaker: str = "trial_id") -> DataFrame:
    return best_trials(trials, [], score_col, tie_breaker)


def top_k(df: DataFrame, group: Sequence[str], order: Column, k: int, tie_breaker: str, salts: int = 64) -> DataFrame:
    """First k rows per group by descending ``order``.

    A first round inside salted sub-groups leaves k rows per salt, so a hot group never meets in one task.
    """
    from pyspark.sql import Window as W

    group = list(group)
    salted = df.withColumns({"_salt": F.pmod(F.xxhash64(tie_breaker), F.lit(salts)), "_o": order})
    best = [F.col("_o").desc_nulls_last(), F.col(tie_breaker)]
    first = W.partitionBy(*group, "_salt").orderBy(*best)
    second = W.partitionBy(*group).orderBy(*best)
    return (
        salted.withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= k)
        .withColumn("rank", F.row_number().over(second))
        .filter(F.col("rank") <= k)
        .drop("_salt", "_o", "_r")
    )


def grid_match(winners: DataFrame, earlier: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Compare winners with the best earlier value in the same grid cell; unmatched cells stay NULL."""
    keys = list(keys)
    best = earlier.groupBy(*keys).agg(*[F.max(m).alias(f"v1_best_{m}") for m in metrics])
    return winners.join(best, keys, "left").withColumns(
        {f"{m}_delta": F.col(m) - F.col(f"v1_best_{m}") for m in metrics}
    )


def seed_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], digits: int = 4) -> DataFrame:
    """Mean, std, min, median and max of each metric over the seeds, rounded."""
    from cohortlake.operators.ordering import exact_quantiles

    keys = list(keys)
    aggs = []
    for m in metrics:
        aggs += [
            F.round(F.avg(m), digits).alias(f"{m}_mean"), F.round(F.stddev_samp(m), digits).alias(f"{m}_std"),
            F.round(F.min(m), digits).alias(f"{m}_min"), F.round(F.max(m), digits).alias(f"{m}_max"),
        ]
    out = df.groupBy(*keys).agg(*aggs)
    long = df.select(*keys, *metrics).unpivot(keys, list(metrics), "_metric", "_value")
    med = exact_quantiles(long, [*keys, "_metric"], "_value", {"_median": 0.5})
    wide = med.groupBy(*keys).agg(
        *[F.round(F.max(F.when(F.col("_metric") == m, F.col("_median"))), digits).alias(f"{m}_median") for m in metrics]
    )
    return out.join(wide, keys, "left")


def mean_std(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and std of the metrics that exist, and the number of rows per key."""
    aggs = []
    for m in (m for m in metrics if m in df.columns):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_seeds"))
