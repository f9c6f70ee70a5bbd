"""Metrics over a prediction table (config keys, y_true, y_prob, optional weight).

Rows are first collapsed to one row per (config, score); ranks come from level-wise running sums, so a
config with most of the rows is still spread over many tasks. Undefined values are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.functions import exprs as E
from cohortlake.operators.ordering import running_totals, score_levels

Y, P = "y_true", "y_prob"


def by_score(preds: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """(keys, y_prob, n_at, pos_at): how many rows and positives share each score."""
    w = F.col(weight) if weight else F.lit(1)
    return (
        preds.filter(F.col(P).isNotNull())
        .groupBy(*keys, P)
        .agg(F.sum(w.cast("bigint")).alias("n_at"), F.sum((w * F.col(Y)).cast("bigint")).alias("pos_at"))
    )


def cumulative(preds: DataFrame, keys: Sequence[str], weight: str | None = None, extra_cuts: Sequence[float] = ()) -> DataFrame:
    """Running counts by descending score: at cut y_prob, cum_n rows and cum_pos positives score at least that.

    ``extra_cuts`` adds thresholds that no row has. Adds the totals n and pos of the config.
    """
    keys = list(keys)
    base = by_score(preds, keys, weight)
    if extra_cuts:
        cuts = F.explode(F.array(*[F.lit(float(c)) for c in extra_cuts])).alias(P)
        zero = F.lit(0).cast("bigint")
        added = base.select(*keys).distinct().select(*keys, cuts, zero.alias("n_at"), zero.alias("pos_at"))
        base = base.unionByName(added).groupBy(*keys, P).agg(F.sum("n_at").alias("n_at"), F.sum("pos_at").alias("pos_at"))
    ranked = running_totals(
        base, keys, score_levels(F.col(P), descending=True), [F.col(P).desc()],
        {"cum_n": "n_at", "cum_pos": "pos_at"}, totals=True,
    )
    return ranked.withColumnsRenamed({"cum_n_total": "n", "cum_pos_total": "pos"})


def _auc_terms() -> tuple[Column, Column]:
    neg_at = F.col("n_at") - F.col("pos_at")
    pos_above = F.col("cum_pos") - F.col("pos_at")
    roc = F.sum(neg_at.cast("double") * (pos_above + F.col("pos_at") / 2.0))
    pr = F.sum(E.ratio("pos_at", "pos") * E.ratio("cum_pos", "cum_n"))
    return roc, pr


def auc(preds: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """ROC-AUC with ties averaged and average precision (step sum) per config, plus n and pos."""
    roc, pr = _auc_terms()
    n, pos = F.col("n"), F.col("pos")
    both = (pos > 0) & (pos < n)
    return (
        cumulative(preds, keys, weight)
        .groupBy(*keys, "n", "pos")
        .agg(roc.alias("_roc"), pr.alias("_pr"))
        .select(
            *keys, n, pos,
            F.when(both, E.ratio(F.col("_roc"), pos.cast("double") * (n - pos))).alias("roc_auc"),
            F.when(pos > 0, F.col("_pr")).alias("pr_auc"),
        )
    )


def confusion(preds: DataFrame, keys: Sequence[str], threshold: float | Column = 0.5) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 (0 on zero division), and Brier score."""
    hit = F.col(P) >= threshold
    y = F.col(Y) == 1
    return (
        preds.groupBy(*keys)
        .agg(
            F.count_if(hit & y).alias("tp"),
            F.count_if(hit & ~y).alias("fp"),
            F.count_if(~hit & y).alias("fn"),
            F.count_if(~hit & ~y).alias("tn"),
            F.avg((F.col(P) - F.col(Y)) * (F.col(P) - F.col(Y))).alias("brier"),
        )
        .withColumns(rates())
    )


def rates(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> dict[str, Column]:
    t, f, m, n = (F.col(c).cast("double") for c in (tp, fp, fn, tn))

    def safe(num: Column, den: Column) -> Column:
        return F.coalesce(F.try_divide(num, den), F.lit(0.0))

    return {
        "accuracy": safe(t + n, t + f + m + n),
        "precision": safe(t, t + f),
        "recall": safe(t, t + m),
        "f1": safe(2 * t, 2 * t + f + m),
    }


PANEL = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier"]


def panel(preds: DataFrame, keys: Sequence[str], threshold: float | Column = 0.5) -> DataFrame:
    """The seven-metric panel; ranking metrics and Brier are NULL unless both classes are present."""
    keys = list(keys)
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    joined = confusion(preds, keys, threshold).join(auc(preds, keys), keys)
    return joined.select(
        *keys, "n", "pos", "accuracy", "precision", "recall", "f1", "roc_auc",
        *[F.when(both, F.col(c)).alias(c) for c in ("pr_auc", "brier")],
    )


def best_f1_threshold(preds: DataFrame, keys: Sequence[str], default: float = 0.5) -> DataFrame:
    """Threshold with the best F1 over observed scores and the default; the lowest wins a tie.

    One-class configs keep the default.
    """
    keys = list(keys)
    f1 = 2.0 * F.col("cum_pos") / (F.col("cum_n") + F.col("pos"))
    found = (
        cumulative(preds, keys, extra_cuts=[default])
        .filter(F.col("cum_n") > 0)
        .groupBy(*keys, "n", "pos")
        .agg(F.max(F.struct(f1.alias("f1"), (-F.col(P)).alias("neg_cut"))).alias("best"))
    )
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    return found.select(
        *keys,
        F.when(both, -F.col("best.neg_cut")).otherwise(default).alias("score_cut"),
        F.when(both, F.col("best.f1")).alias("best_f1"),
    )


def _at_floor(preds: DataFrame, keys: Sequence[str], value: str, floor_on: str, floor: float, out: str) -> DataFrame:
    keys = list(keys)
    cut = cumulative(preds, keys).withColumns(
        {"precision": F.col("cum_pos") / F.col("cum_n"), "recall": E.ratio("cum_pos", "pos")}
    )
    best = F.max(
        F.when(F.col(floor_on) >= floor, F.struct(F.col(value).alias("v"), (-F.col(P)).alias("neg_cut")))
    )
    return (
        cut.groupBy(*keys, "pos")
        .agg(best.alias("best"))
        .select(
            *keys,
            F.when(F.col("pos") > 0, F.coalesce(F.col("best.v"), F.lit(0.0))).alias(out),
            F.when(F.col("pos") > 0, -F.col("best.neg_cut")).alias("score_cut"),
        )
    )


def recall_at_precision(preds: DataFrame, keys: Sequence[str], floor: float = 0.20) -> DataFrame:
    """Best recall with precision at least ``floor``; 0 and NULL when no cut reaches it."""
    return _at_floor(preds, keys, "recall", "precision", floor, "recall_at_precision_floor")


def precision_at_recall(preds: DataFrame, keys: Sequence[str], floor: float = 0.50) -> DataFrame:
    return _at_floor(preds, keys, "precision", "recall", floor, "precision_at_recall_floor")


def roc_points(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    fp, neg = F.col("cum_n") - F.col("cum_pos"), F.col("n") - F.col("pos")
    return cumulative(preds, keys).select(
        *keys, F.col(P).alias("score_cut"), E.ratio(fp, neg).alias("fpr"), E.ratio("cum_pos", "pos").alias("tpr")
    )


def pr_points(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision-recall points and the prevalence line."""
    return cumulative(preds, keys).select(
        *keys, F.col(P).alias("score_cut"), E.ratio("cum_pos", "pos").alias("recall"),
        E.ratio("cum_pos", "cum_n").alias("precision"), E.ratio("pos", "n").alias("prevalence"),
    )


def calibration(preds: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean score and positive share per uniform score bin; empty bins are absent."""
    b = F.least(F.floor(F.col(P) * bins), F.lit(bins - 1)).cast("int")
    return preds.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(P).alias("mean_score"), F.avg(Y).alias("positive_share")
    )


def histogram(preds: DataFrame, keys: Sequence[str], bins: int = 40) -> DataFrame:
    b = F.least(F.floor(F.col(P) * bins), F.lit(bins - 1)).cast("int")
    return preds.groupBy(*keys, F.col(Y), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(preds: DataFrame, keys: Sequence[str], first: int = 5, last: int = 94) -> DataFrame:
    """Rates at the fixed thresholds first..last hundredths.

    Rows are collapsed to the number of thresholds they pass before the sweep, so the data are read once
    and the layout costs only (config, step, class) rows.
    """
    keys = list(keys)
    step = F.floor(F.col(P) * 100)
    above, below = F.col(P) >= (step + 1) / 100.0, F.col(P) < step / 100.0
    passed = (step + above.cast("int") - below.cast("int")).cast("int")
    counts = preds.groupBy(*keys, passed.alias("_step")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(Y).alias("_pos")
    )
    laid = counts.withColumn("_t", F.explode(F.sequence(F.lit(first), F.lit(last))))
    hit = F.col("_step") >= F.col("_t")
    neg = F.col("_n") - F.col("_pos")
    swept = laid.groupBy(*keys, "_t").agg(
        F.sum(F.when(hit, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("_pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~hit, neg).otherwise(0)).alias("tn"),
    )
    return swept.withColumns({"score_cut": F.round(F.col("_t") / 100.0, 2), **rates()}).drop("_t")


def operating_points(sweep: DataFrame, keys: Sequence[str], recall: float = 0.8, precision: float = 0.7) -> DataFrame:
    """Highest threshold that keeps the recall and lowest one that reaches the precision."""
    return sweep.groupBy(*keys).agg(
        F.max(F.when(F.col("recall") >= recall, F.col("score_cut"))).alias("high_recall_cut"),
        F.min(F.when(F.col("precision") >= precision, F.col("score_cut"))).alias("high_precision_cut"),
    )


def pooled(fold_preds: DataFrame, config: str = "config", fold: str = "user_key") -> DataFrame:
    """Metrics over all folds pooled, with the spread of the per-fold ROC-AUC."""
    per_fold = auc(fold_preds, [config, fold])
    folds = per_fold.groupBy(config).agg(
        F.avg("roc_auc").alias("per_patient_roc_mean"),
        F.stddev_samp("roc_auc").alias("per_patient_roc_std"),
        F.min("roc_auc").alias("per_patient_roc_min"),
        F.max("roc_auc").alias("per_patient_roc_max"),
        F.count_if(F.col("pos") > 0).alias("n_folds_with_pos"),
    )
    total = fold_preds.groupBy(config).agg(F.countDistinct(fold).alias("n_folds_total"))
    whole = auc(fold_preds, [config]).select(
        config, F.col("roc_auc").alias("pooled_roc_auc"), F.col("pr_auc").alias("pooled_pr_auc"),
        F.col("n").alias("pooled_n"), F.col("pos").alias("pooled_n_pos"),
    )
    return whole.join(folds, config).join(total, config)
