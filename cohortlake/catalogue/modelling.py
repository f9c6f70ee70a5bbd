"""Model jobs over the labelled vectors.

Fitted numbers have no SQL twin. Queries with a twin return what the data determine (ids, labels, sizes) and whether
the fitted part is what a right fit gives: the gradient of the penalised loss is zero, training rows are scored better
than by any constant, calibration is affine in log-odds. The numbers are for callers and the unit tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.catalogue.common import rounded
from cohortlake.catalogue.registry import query
from cohortlake.operators import splits
from cohortlake.plans import models as M
from cohortlake.sources import standin as V
from cohortlake.sources.tables import materialize

DIMS = 64
X = [f"x{i}" for i in range(DIMS)]
LR, RF, GBT = {"C": 1.0}, {"n_estimators": 200, "max_depth": 5}, {"n_estimators": 20, "max_depth": 3}


def table(spark, d):
    emb = F.col("embedding")
    return V.vectors(spark, d).select("sample_id", "user_key", "target", *[emb[i].alias(c) for i, c in enumerate(X)])


def fitted_scores(spark, d, algo, params):
    data = materialize(table(spark, d))
    train = data.filter("user_key < 9")
    model = M.fit(train, X, algo, params)
    scores = M.score(model, data.filter("user_key >= 9"), ["sample_id", "user_key"])
    out = scored_rows(scores).withColumn("beats_constant", F.lit(M.beats_constant(model, train, algo, params)))
    return out.withColumn("stationary", F.lit(M.gradient(model, train, params) < 1e-4)) if algo == "lr" else out


def scored_rows(scores, value="y_prob"):
    """The rows of a score table, with their scores replaced by whether they are probabilities."""
    good = F.col(value).isNotNull() & F.col(value).between(0, 1)
    return scores.withColumn("in_range", good).drop("y_prob", "y_cal")


SCORED = "SELECT sample_id, user_key, CAST(target AS INTEGER) AS y_true, true AS in_range, true AS beats_constant FROM vectors WHERE user_key >= 9"


@query("mod_01_logistic_regression", SCORED.replace(" FROM", ", true AS stationary FROM"), "vectors")
def _(spark, d):
    return fitted_scores(spark, d, "lr", LR | {"class_weight": "balanced"})


@query("mod_02_random_forest", SCORED, "vectors")
def _(spark, d):
    return fitted_scores(spark, d, "rf", RF | {"class_weight": "balanced"})


@query("mod_03_boosted_trees", SCORED, "vectors")
def _(spark, d):
    return fitted_scores(spark, d, "gbt", GBT)


@query("mod_05_platt_calibration", SCORED.replace("user_key, ", "").replace("beats_constant", "affine"), "vectors")
def _(spark, d):
    data = materialize(table(spark, d))
    model = M.fit(data.filter("user_key < 6"), X, "rf", RF)
    val = M.score(model, data.filter("user_key between 6 and 8"), ["sample_id"])
    scores = materialize(M.platt(val, M.score(model, data.filter("user_key >= 9"), ["sample_id"])))
    odds = F.log(F.col("y_cal") / (1 - F.col("y_cal")))
    tied = scores.agg(F.abs(F.corr("y_prob", odds))).first()[0]
    return scored_rows(scores, "y_cal").withColumn("affine", F.lit(bool(tied and tied > 1 - 1e-6)))


@query("mod_07_stacking")
def _(spark, d):
    return rounded(M.stack(table(spark, d), X, [("lr", LR), ("rf", RF), ("gbt", GBT)]))


@query("mod_08_feature_importance")
def _(spark, d):
    model = M.fit(table(spark, d), X, "rf", RF)
    return rounded(M.importances(model, spark))


@query("mod_09_parameter_sweep")
def _(spark, d):
    # Two grid cells: all rows, and half of the rows of each user.
    t = table(spark, d)
    cells = t.withColumn("threshold", F.lit(2)).unionByName(t.filter("sample_id % 4 < 2").withColumn("threshold", F.lit(3)))
    trials = M.param_grid({"lr": {"C": [0.1, 1.0]}, "rf": {"n_estimators": [10], "max_depth": [3]}})
    return rounded(M.sweep(cells, splits.three_way_split(t), X, ["threshold"], trials))


@query("mod_09_tuned_headline")
def _(spark, d):
    from cohortlake.plans import reports

    # Tune, select, refit and report on one table: two grid cells as above.
    t = table(spark, d)
    cells = t.withColumn("threshold", F.lit(2)).unionByName(t.filter("sample_id % 4 < 2").withColumn("threshold", F.lit(3)))
    cells = cells.withColumns({"input_length_days": F.lit(7), "washout_days": F.lit(0)})
    trials = M.param_grid({"lr": {"C": [0.1, 1.0]}, "rf": {"n_estimators": [20], "max_depth": [3]}})
    _, final = M.tune_and_test(cells, splits.three_way_split(t), X, ["threshold", "input_length_days", "washout_days"], trials)
    return rounded(reports.headline(final))


@query("mod_10_train_test_table")
def _(spark, d):
    return rounded(M.train_test_table(table(spark, d), X, [("lr", LR), ("rf", RF)]))


@query("mod_11_refit_and_test")
def _(spark, d):
    t = table(spark, d)
    return rounded(M.refit_and_test(t, splits.three_way_split(t), X, [("lr", LR), ("rf", RF)])[0])


@query("mod_12_source_ablation")
def _(spark, d):
    t = table(spark, d)
    subsets = {"all": X, "first_half": X[: DIMS // 2], "second_half": X[DIMS // 2 :]}
    return rounded(M.ablation(t, splits.three_way_split(t), subsets, "lr", LR))


@query("mod_13_leakage_probe")
def _(spark, d):
    t = table(spark, d)
    probe = M.leakage_probe(t, splits.three_way_split(t), X, "lr", LR, shuffles=5)
    overall = probe.agg(F.avg("roc_auc").alias("val_roc_auc_mean"), F.count("*").alias("n_shuffles"))
    return rounded(M.probe_gate(overall))


@query(
    "mod_14_leave_one_user_out",
    """SELECT 'lr' AS config, count(*) AS pooled_n, CAST(sum(target) AS BIGINT) AS pooled_n_pos, count(DISTINCT user_key) AS n_folds_total,
         count(DISTINCT user_key) FILTER (target = 1) AS n_folds_with_pos, true AS in_range, true AS stationary FROM vectors""",
    "vectors",
)
def _(spark, d):
    from cohortlake.operators import ranking

    oof, fits = M.linear_folds(table(spark, d), X, M.USER, [M.USER, "sample_id"], LR)
    sizes = ["config", "pooled_n", "pooled_n_pos", "n_folds_total", "n_folds_with_pos"]
    out = ranking.pooled(materialize(oof).withColumn("config", F.lit("lr"))).select(*sizes, F.col("pooled_roc_auc").between(0, 1).alias("in_range"))
    return out.withColumn("stationary", F.lit(fits.filter("gradient IS NULL OR gradient < 1e-6").count() == fits.count()))


@query("mod_15_subset_panel")
def _(spark, d):
    subsets = {"half": X[: DIMS // 2], "all": X}
    return rounded(M.panel_runs(table(spark, d), subsets, [("lr", LR)], seeds=[42, 43], n_boot=20))


@query("mod_16_grouped_cv")
def _(spark, d):
    return rounded(M.grouped_cv(table(spark, d), X, [("lr", LR)], n_splits=5))
