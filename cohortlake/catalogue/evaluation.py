"""Ranking metrics, resampling, selection and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.catalogue import aggregates as AG
from cohortlake.catalogue.common import rounded, sql_rounded
from cohortlake.catalogue.ctes import cte
from cohortlake.catalogue.registry import query
from cohortlake.functions import exprs as E
from cohortlake.operators import profile, ranking as R, resample as RS, select, splittree
from cohortlake.operators.ordering import integer_levels, number_rows
from cohortlake.plans import models as M, reports
from cohortlake.sources import standin as V

K = ["config"]

# Brute-force twins: every score is compared with every other score of its config.
cte("cuts", "preds", """
SELECT config, y_prob, count(*) AS n_at, CAST(sum(y_true) AS BIGINT) AS pos_at FROM preds GROUP BY config, y_prob
""")
cte("sized", "preds", "SELECT config, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS pos FROM preds GROUP BY config")
cte("cum", "cuts sized", """
SELECT *, CAST(sum(n_at) OVER w AS BIGINT) AS cum_n, CAST(sum(pos_at) OVER w AS BIGINT) AS cum_pos
FROM cuts JOIN sized USING (config) WINDOW w AS (PARTITION BY config ORDER BY y_prob DESC)
""")
cte("aucs", "preds cum sized", """
SELECT s.config, s.n, s.pos,
  (SELECT sum(CASE WHEN a.y_prob > b.y_prob THEN 1.0::DOUBLE WHEN a.y_prob = b.y_prob THEN 0.5::DOUBLE ELSE 0 END)
   FROM preds a JOIN preds b ON a.config = b.config AND a.y_true = 1 AND b.y_true = 0 WHERE a.config = s.config)
   / nullif(CAST(s.pos * (s.n - s.pos) AS DOUBLE), 0) AS roc_auc,
  (SELECT sum(pos_at / nullif(CAST(pos AS DOUBLE), 0) * cum_pos / cum_n) FROM cum WHERE cum.config = s.config) AS pr_auc
FROM sized s
""")
CONFUSION = """
SELECT config, count(*) FILTER (y_prob >= 0.5 AND y_true = 1) AS tp, count(*) FILTER (y_prob >= 0.5 AND y_true = 0) AS fp,
       count(*) FILTER (y_prob < 0.5 AND y_true = 1) AS fn, count(*) FILTER (y_prob < 0.5 AND y_true = 0) AS tn,
       avg((y_prob - y_true) * (y_prob - y_true)) AS brier,
       avg(CAST((y_prob >= 0.5) = (y_true = 1) AS INTEGER)) AS accuracy,
       coalesce(count(*) FILTER (y_prob >= 0.5 AND y_true = 1) / nullif(CAST(count(*) FILTER (y_prob >= 0.5) AS DOUBLE), 0), 0) AS precision,
       coalesce(count(*) FILTER (y_prob >= 0.5 AND y_true = 1) / nullif(CAST(sum(y_true) AS DOUBLE), 0), 0) AS recall,
       coalesce(2.0::DOUBLE * count(*) FILTER (y_prob >= 0.5 AND y_true = 1)
         / nullif(CAST(count(*) FILTER (y_prob >= 0.5) + sum(y_true) AS DOUBLE), 0), 0) AS f1
FROM preds GROUP BY config
"""
cte("confusion", "preds", CONFUSION)


@query("evl_01_confusion", sql_rounded("brier accuracy precision recall f1", "SELECT * FROM confusion"), "confusion")
def _(spark, d):
    return rounded(R.confusion(V.preds(spark, d), K))


@query("evl_02_roc_auc", sql_rounded("roc_auc", "SELECT config, roc_auc FROM aucs"), "aucs")
def _(spark, d):
    return rounded(R.auc(V.preds(spark, d), K).select("config", "roc_auc"))


@query("evl_03_average_precision", sql_rounded("pr_auc", "SELECT config, n, pos, pr_auc FROM aucs"), "aucs")
def _(spark, d):
    return rounded(R.auc(V.preds(spark, d), K).select("config", "n", "pos", "pr_auc"))


@query("evl_04_brier", sql_rounded("brier", "SELECT config, brier FROM confusion"), "confusion")
def _(spark, d):
    return rounded(R.confusion(V.preds(spark, d), K).select("config", "brier"))


PANEL_SQL = """SELECT config, n, pos, accuracy, precision, recall, f1, roc_auc, CASE WHEN pos BETWEEN 1 AND n - 1 THEN pr_auc END AS pr_auc,
  CASE WHEN pos BETWEEN 1 AND n - 1 THEN brier END AS brier FROM confusion JOIN aucs USING (config)"""


@query("evl_05_metric_panel", sql_rounded(R.PANEL, PANEL_SQL), "confusion aucs")
def _(spark, d):
    return rounded(R.panel(V.preds(spark, d), K))


@query(
    "evl_05_metric_panel_per_user",
    sql_rounded(["accuracy", "f1", "brier"], """SELECT config, user_key, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS pos,
         avg(CAST((y_prob >= 0.5) = (y_true = 1) AS INTEGER)) AS accuracy,
         coalesce(2.0::DOUBLE * count(*) FILTER (y_prob >= 0.5 AND y_true = 1)
           / nullif(CAST(count(*) FILTER (y_prob >= 0.5) + sum(y_true) AS DOUBLE), 0), 0) AS f1,
         CASE WHEN sum(y_true) BETWEEN 1 AND count(*) - 1 THEN avg((y_prob - y_true) * (y_prob - y_true)) END AS brier
       FROM preds GROUP BY config, user_key"""),
    "preds",
)
def _(spark, d):
    out = R.panel(V.preds(spark, d), ["config", "user_key"])
    return rounded(out.select("config", "user_key", "n", "pos", "accuracy", "f1", "brier"))


@query(
    "evl_06_best_f1_threshold",
    sql_rounded("best_f1", """SELECT config, CASE WHEN pos BETWEEN 1 AND n - 1 THEN t ELSE 0.5 END AS score_cut,
         CASE WHEN pos BETWEEN 1 AND n - 1 THEN f1 END AS best_f1 FROM (
         SELECT *, row_number() OVER (PARTITION BY config ORDER BY f1 DESC, t) AS rn FROM (
           SELECT c.config, c.t, 2.0::DOUBLE * count(*) FILTER (p.y_prob >= c.t AND p.y_true = 1)
                  / (count(*) FILTER (p.y_prob >= c.t) + sum(p.y_true)) AS f1, count(*) FILTER (p.y_prob >= c.t) AS hits
           FROM (SELECT config, y_prob AS t FROM preds UNION SELECT config, 0.5 FROM preds) c JOIN preds p ON p.config = c.config
           GROUP BY c.config, c.t) WHERE hits > 0) JOIN sized USING (config) WHERE rn = 1"""),
    "preds sized",
)
def _(spark, d):
    return rounded(R.best_f1_threshold(V.preds(spark, d), K)).withColumn("score_cut", F.round("score_cut", 4))


FLOOR_SQL = """SELECT config, CASE WHEN pos > 0 THEN coalesce(v, 0) END AS {out}, CASE WHEN pos > 0 THEN y_prob END AS score_cut
FROM sized LEFT JOIN (
  SELECT config, y_prob, {value} AS v, row_number() OVER (PARTITION BY config ORDER BY {value} DESC, y_prob) AS rn
  FROM cum WHERE pos > 0 AND {floor_on} >= {floor}) b USING (config) WHERE coalesce(rn, 1) = 1"""
PREC, REC = "cum_pos / CAST(cum_n AS DOUBLE)", "cum_pos / nullif(CAST(pos AS DOUBLE), 0)"


@query(
    "evl_07_recall_at_precision",
    sql_rounded("recall_at_precision_floor", FLOOR_SQL.format(out="recall_at_precision_floor", value=REC, floor_on=PREC, floor="0.1::DOUBLE")),
    "cum",
)
def _(spark, d):
    return rounded(R.recall_at_precision(V.preds(spark, d), K, 0.1)).withColumn("score_cut", F.round("score_cut", 4))


@query(
    "evl_08_precision_at_recall",
    sql_rounded("precision_at_recall_floor", FLOOR_SQL.format(out="precision_at_recall_floor", value=PREC, floor_on=REC, floor="0.5::DOUBLE")),
    "cum",
)
def _(spark, d):
    return rounded(R.precision_at_recall(V.preds(spark, d), K, 0.5)).withColumn("score_cut", F.round("score_cut", 4))


@query(
    "evl_09_roc_points",
    sql_rounded("fpr tpr", "SELECT config, y_prob AS score_cut, (cum_n - cum_pos) / nullif(CAST(n - pos AS DOUBLE), 0) AS fpr, cum_pos / nullif(CAST(pos AS DOUBLE), 0) AS tpr FROM cum"),
    "cum",
)
def _(spark, d):
    return rounded(R.roc_points(V.preds(spark, d), K)).withColumn("score_cut", F.round("score_cut", 4))


@query(
    "evl_10_pr_points",
    sql_rounded("recall precision prevalence", f"SELECT config, y_prob AS score_cut, {REC} AS recall, {PREC} AS precision, pos / CAST(n AS DOUBLE) AS prevalence FROM cum"),
    "cum",
)
def _(spark, d):
    return rounded(R.pr_points(V.preds(spark, d), K)).withColumn("score_cut", F.round("score_cut", 4))


@query(
    "evl_11_calibration",
    sql_rounded("mean_score positive_share", """SELECT config, CAST(least(floor(y_prob * 10), 9) AS INTEGER) AS bin, count(*) AS n,
         avg(y_prob) AS mean_score, avg(y_true) AS positive_share FROM preds GROUP BY ALL"""),
    "preds",
)
def _(spark, d):
    return rounded(R.calibration(V.preds(spark, d), K))


@query(
    "evl_12_score_histogram",
    "SELECT config, y_true, CAST(least(floor(y_prob * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM preds GROUP BY ALL",
    "preds",
)
def _(spark, d):
    return R.histogram(V.preds(spark, d), K)


cte("sweep", "preds", """
SELECT config, round(t / 100.0::DOUBLE, 2) AS score_cut, count(*) FILTER (y_prob >= t / 100.0::DOUBLE AND y_true = 1) AS tp,
       count(*) FILTER (y_prob >= t / 100.0::DOUBLE AND y_true = 0) AS fp,
       count(*) FILTER (y_prob < t / 100.0::DOUBLE AND y_true = 1) AS fn,
       count(*) FILTER (y_prob < t / 100.0::DOUBLE AND y_true = 0) AS tn
FROM preds, (SELECT unnest(range(5, 95)) AS t) GROUP BY config, t
""")
cte("sweep_rates", "sweep", """
SELECT *, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision,
       coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1
FROM sweep
""")


@query("evl_13_threshold_sweep", sql_rounded("accuracy precision recall f1", "SELECT * FROM sweep_rates"), "sweep_rates")
def _(spark, d):
    return rounded(R.threshold_sweep(V.preds(spark, d), K)).withColumn("score_cut", F.round("score_cut", 2))


@query(
    "evl_13_operating_points",
    """SELECT config, max(score_cut) FILTER (recall >= 0.8) AS high_recall_cut,
              min(score_cut) FILTER (precision >= 0.15) AS high_precision_cut FROM sweep_rates GROUP BY config""",
    "sweep_rates",
)
def _(spark, d):
    return R.operating_points(R.threshold_sweep(V.preds(spark, d), K), K, 0.8, 0.15)


cte("diagnosed", "trials", """
SELECT *, train_pr_auc - val_pr_auc AS train_val_pr_auc_gap, val_pr_auc - test_pr_auc AS val_test_pr_auc_gap,
       coalesce(train_pr_auc - val_pr_auc > 0.2, false) AS overfit_gap_flag,
       val_pr_auc IS NOT NULL AND (val_recall <= 0.05 OR val_f1 <= 0.05) AS low_val_event_detection_flag
FROM trials
""")
GAPS = "train_val_pr_auc_gap val_test_pr_auc_gap"


@query(
    "evl_14_diagnostics",
    sql_rounded(GAPS, "SELECT trial_id, train_val_pr_auc_gap, val_test_pr_auc_gap, overfit_gap_flag, low_val_event_detection_flag FROM diagnosed"),
    "diagnosed",
)
def _(spark, d):
    out = select.diagnostics(V.trials(spark, d))
    return rounded(out.select("trial_id", *GAPS.split(), "overfit_gap_flag", "low_val_event_detection_flag"))


ORDER = """val_pr_auc DESC NULLS LAST, val_recall_at_precision_floor DESC NULLS LAST, train_val_pr_auc_gap NULLS LAST, val_brier,
  n_features, val_roc_auc DESC, val_f1 DESC, trial_id"""
cte("best", "diagnosed", f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY algo ORDER BY {ORDER}) AS rn FROM diagnosed) WHERE rn = 1
""")


@query("evl_15_best_trials", sql_rounded(GAPS, "SELECT * FROM best"), "best")
def _(spark, d):
    out = select.best_trials(V.trials(spark, d), ["algo"])
    return out.withColumns({g: rounded_gap(g) for g in GAPS.split()})


def rounded_gap(name):
    from cohortlake.catalogue.common import DIGITS, HAIR

    return F.round(F.col(name) + HAIR, DIGITS)


@query(
    "win_05_top_one_per_group",
    f"""SELECT subset, trial_id, val_pr_auc FROM (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY {ORDER}) AS rn FROM diagnosed) WHERE rn = 1""",
    "diagnosed",
)
def _(spark, d):
    return select.best_trials(V.trials(spark, d), ["subset"]).select("subset", "trial_id", "val_pr_auc")


@query(
    "win_06_top_k_per_group",
    """SELECT algo, subset, trial_id, val_pr_auc, CAST(rn AS INTEGER) AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY algo ORDER BY val_pr_auc DESC NULLS LAST, trial_id) AS rn FROM trials) WHERE rn <= 5""",
    "trials",
)
def _(spark, d):
    t = V.trials(spark, d).select("algo", "subset", "trial_id", "val_pr_auc")
    return select.top_k(t, ["algo"], F.col("val_pr_auc"), 5, "trial_id")


@query("evl_16_guarded_auc", sql_rounded("roc_auc pr_auc", """
SELECT config, user_key, n, pos, CASE WHEN pos > 0 AND pos < n THEN roc / (pos * (n - pos)) END AS roc_auc, CASE WHEN pos > 0 THEN pr END AS pr_auc FROM (
  SELECT g.config, g.user_key, g.n, g.pos,
    (SELECT sum(CASE WHEN a.y_prob > b.y_prob THEN 1.0::DOUBLE WHEN a.y_prob = b.y_prob THEN 0.5::DOUBLE ELSE 0 END) FROM preds a JOIN preds b
       ON a.config = b.config AND a.user_key = b.user_key AND a.y_true = 1 AND b.y_true = 0 WHERE a.config = g.config AND a.user_key = g.user_key) AS roc,
    (SELECT sum(x.pos_at / CAST(g.pos AS DOUBLE) * x.cum_pos / x.cum_n) FROM (
       SELECT config, user_key, y_prob, sum(y_true) AS pos_at, sum(sum(y_true)) OVER w AS cum_pos, sum(count(*)) OVER w AS cum_n
       FROM preds GROUP BY config, user_key, y_prob WINDOW w AS (PARTITION BY config, user_key ORDER BY y_prob DESC)) x
     WHERE x.config = g.config AND x.user_key = g.user_key AND g.pos > 0) AS pr
  FROM (SELECT config, user_key, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS pos FROM preds GROUP BY ALL) g)"""), "preds")
def _(spark, d):
    return rounded(R.auc(V.preds(spark, d), ["config", "user_key"]))


@query(
    "win_09_cumulative_counts",
    "SELECT config, y_prob, n_at, pos_at, cum_n, cum_pos FROM cum",
    "cum",
)
def _(spark, d):
    out = R.cumulative(V.preds(spark, d), K)
    return out.select("config", "y_prob", "n_at", "pos_at", "cum_n", "cum_pos")


cte("folds", "preds", """
SELECT config, user_key, n, pos, CASE WHEN pos > 0 AND pos < n THEN roc / (pos * (n - pos)) END AS roc_auc FROM (
  SELECT g.*, (SELECT sum(CASE WHEN a.y_prob > b.y_prob THEN 1.0::DOUBLE WHEN a.y_prob = b.y_prob THEN 0.5::DOUBLE ELSE 0 END) FROM preds a JOIN preds b
       ON a.config = b.config AND a.user_key = b.user_key AND a.y_true = 1 AND b.y_true = 0 WHERE a.config = g.config AND a.user_key = g.user_key) AS roc
  FROM (SELECT config, user_key, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS pos FROM preds GROUP BY ALL) g)
""")


@query(
    "agg_24_pooled_folds",
    sql_rounded("pooled_roc_auc pooled_pr_auc per_patient_roc_mean per_patient_roc_std per_patient_roc_min per_patient_roc_max",
                """SELECT a.config, a.roc_auc AS pooled_roc_auc, a.pr_auc AS pooled_pr_auc, a.n AS pooled_n, a.pos AS pooled_n_pos, f.* EXCLUDE (config)
       FROM aucs a JOIN (SELECT config, avg(roc_auc) AS per_patient_roc_mean, stddev_samp(roc_auc) AS per_patient_roc_std, min(roc_auc) AS per_patient_roc_min,
         max(roc_auc) AS per_patient_roc_max, count(*) FILTER (pos > 0) AS n_folds_with_pos, count(*) AS n_folds_total FROM folds GROUP BY config) f USING (config)"""),
    "aucs folds",
)
def _(spark, d):
    return rounded(R.pooled(V.preds(spark, d)))


# --- resampling -----------------------------------------------------------------------------------

N_BOOT = 20
cte("row_numbers", "preds", """
SELECT *, row_number() OVER (PARTITION BY config ORDER BY md5('rows:' || sample_id), sample_id) - 1 AS idx, count(*) OVER (PARTITION BY config) AS size FROM preds
""")
cte("row_draws", "row_numbers", f"""
SELECT n.config, n.draw, CAST(('0x' || substr(md5('42:' || n.draw || ':' || n.idx), 1, 15)) AS BIGINT) % n.size AS idx
FROM (SELECT *, unnest(range({N_BOOT})) AS draw FROM row_numbers) n
""")


def draw_metrics(rows: str) -> str:
    """Metrics per (config, draw) of the resampled rows."""
    return f"""
SELECT config, draw, n, pos, CASE WHEN pos > 0 AND pos < n THEN roc / (CAST(pos AS DOUBLE) * (n - pos)) END AS roc_auc, CASE WHEN pos > 0 THEN pr / pos END AS pr_auc FROM (
  SELECT config, draw, CAST(sum(n_at) AS BIGINT) AS n, CAST(sum(pos_at) AS BIGINT) AS pos, sum((n_at - pos_at) * (cum_pos - pos_at + pos_at / 2.0::DOUBLE)) AS roc,
         sum(pos_at * (cum_pos / CAST(cum_n AS DOUBLE))) AS pr
  FROM (SELECT *, sum(n_at) OVER w AS cum_n, sum(pos_at) OVER w AS cum_pos FROM (
          SELECT config, draw, y_prob, count(*) AS n_at, sum(y_true) AS pos_at FROM {rows} GROUP BY ALL)
        WINDOW w AS (PARTITION BY config, draw ORDER BY y_prob DESC))
  GROUP BY config, draw)"""


cte("row_resamples", "row_draws row_numbers", draw_metrics("(SELECT d.config, d.draw, r.y_prob, r.y_true FROM row_draws d JOIN row_numbers r USING (config, idx))"))
CI = "roc_auc pr_auc roc_auc_lo roc_auc_hi pr_auc_lo pr_auc_hi"


@query(
    "rsm_01_row_bootstrap_ci",
    sql_rounded(CI, """SELECT a.config, a.n, a.pos, CASE WHEN a.pos BETWEEN 1 AND a.n - 1 AND a.n >= 5 THEN a.roc_auc END AS roc_auc,
         CASE WHEN a.pos BETWEEN 1 AND a.n - 1 AND a.n >= 5 THEN a.pr_auc END AS pr_auc, quantile_cont(r.roc_auc, 0.025) AS roc_auc_lo, quantile_cont(r.roc_auc, 0.975) AS roc_auc_hi,
         quantile_cont(r.pr_auc, 0.025) FILTER (r.roc_auc IS NOT NULL) AS pr_auc_lo, quantile_cont(r.pr_auc, 0.975) FILTER (r.roc_auc IS NOT NULL) AS pr_auc_hi
       FROM aucs a JOIN row_resamples r ON r.config = a.config GROUP BY ALL"""),
    "aucs row_resamples",
)
def _(spark, d):
    return rounded(RS.bootstrap_ci(V.preds(spark, d), K, "sample_id", N_BOOT))


@query("rsm_01_row_draws", sql_rounded("roc_auc pr_auc", "SELECT * FROM row_resamples"), "row_resamples")
def _(spark, d):
    return rounded(RS.row_bootstrap(V.preds(spark, d), K, "sample_id", N_BOOT)).withColumn("draw", F.col("draw").cast("bigint"))


cte("user_numbers", "preds", """
SELECT *, row_number() OVER (PARTITION BY config ORDER BY md5('users:' || user_key), user_key) - 1 AS idx, count(*) OVER (PARTITION BY config) AS size
FROM (SELECT DISTINCT config, user_key FROM preds)
""")
cte("user_resamples", "user_numbers", draw_metrics(f"""(
  SELECT n.config, n.draw, p.y_prob, p.y_true
  FROM (SELECT *, unnest(range({N_BOOT})) AS draw FROM user_numbers) n
  JOIN user_numbers u ON u.config = n.config AND u.idx = CAST(('0x' || substr(md5('42:' || n.draw || ':' || n.idx), 1, 15)) AS BIGINT) % n.size
  JOIN preds p ON p.config = u.config AND p.user_key = u.user_key)"""))


@query("rsm_02_cluster_bootstrap", sql_rounded("roc_auc pr_auc", "SELECT * FROM user_resamples"), "user_resamples preds")
def _(spark, d):
    out = RS.cluster_bootstrap(V.preds(spark, d), K, "user_key", N_BOOT)
    return rounded(out).withColumn("draw", F.col("draw").cast("bigint"))


@query(
    "evl_17_panel_with_interval",
    sql_rounded("f1 roc_auc pr_auc auc_ci_lo auc_ci_hi", """SELECT c.config, c.f1, a.roc_auc, CASE WHEN a.pos BETWEEN 1 AND a.n - 1 THEN a.pr_auc END AS pr_auc, quantile_cont(u.roc_auc, 0.025) AS auc_ci_lo, quantile_cont(u.roc_auc, 0.975) AS auc_ci_hi
       FROM confusion c JOIN aucs a USING (config) JOIN user_resamples u ON u.config = c.config GROUP BY ALL"""),
    "confusion aucs user_resamples",
)
def _(spark, d):
    p = V.preds(spark, d)
    ci = RS.interval(RS.cluster_bootstrap(p, K, "user_key", N_BOOT), K, ["roc_auc"])
    return rounded(R.panel(p, K).join(ci, K, "left").select(
        "config", "f1", "roc_auc", "pr_auc", F.col("roc_auc_lo").alias("auc_ci_lo"), F.col("roc_auc_hi").alias("auc_ci_hi")
    ))


@query(
    "rsm_03_shuffle_labels",
    """SELECT a.config, a.sample_id, a.y_true, b.y_true AS y_true_shuffled FROM
         (SELECT *, row_number() OVER (PARTITION BY config ORDER BY md5('receiver:' || sample_id), sample_id) AS rn FROM preds) a
         JOIN (SELECT *, row_number() OVER (PARTITION BY config ORDER BY md5('7:' || sample_id), sample_id) AS rn FROM preds) b
         ON a.config = b.config AND a.rn = b.rn""",
    "preds",
)
def _(spark, d):
    p = V.preds(spark, d).select("config", "sample_id", "y_true")
    return RS.shuffle_labels(p, K, "sample_id", "y_true", 7)


def block_sql(seed: int, perm: int = 0) -> str:
    return f"""
SELECT {perm} AS perm, r.sample_id, r.user_key, g.user_key AS donor, r.y_true, r.y_prob, l.y_true AS y_true_perm
FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY sample_id) AS rn FROM preds) r
JOIN (SELECT user_key, row_number() OVER (ORDER BY md5('users:' || user_key), user_key) AS place FROM (SELECT DISTINCT user_key FROM preds)) t ON t.user_key = r.user_key
JOIN (SELECT user_key, n, row_number() OVER (ORDER BY md5('{seed}:{perm}:' || user_key), user_key) AS place FROM (SELECT user_key, count(*) AS n FROM preds GROUP BY user_key)) g ON g.place = t.place
JOIN (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY sample_id) AS rn FROM preds) l ON l.user_key = g.user_key AND l.rn = (r.rn - 1) % g.n + 1"""


@query("rsm_04_user_block_permutation", block_sql(3), "preds")
def _(spark, d):
    p = V.preds(spark, d).select("sample_id", "user_key", "y_true", "y_prob")
    return RS.permute_user_blocks(p, "user_key", "sample_id", "y_true", 3)


@query(
    "win_07_donor_positions",
    "SELECT user_key, sample_id, row_number() OVER (PARTITION BY user_key ORDER BY sample_id) AS rn FROM preds",
    "preds",
)
def _(spark, d):
    p = V.preds(spark, d).select("user_key", "sample_id")
    return number_rows(p, ["user_key"], integer_levels(F.col("sample_id")), [F.col("sample_id")])


N_PERM = 4
cte("null_draws", "preds", " UNION ALL ".join(f"SELECT * FROM ({block_sql(0, i)})" for i in range(N_PERM)))
cte("null_metrics", "null_draws", draw_metrics("(SELECT 'all' AS config, perm AS draw, y_prob, y_true_perm AS y_true FROM null_draws)"))
cte("real_metric", "preds", draw_metrics("(SELECT 'all' AS config, 0 AS draw, y_prob, y_true FROM preds)"))
NULL_COLS = "real_value null_mean null_std null_q05 null_q50 null_q95 p_value"
NULL_SQL = """
SELECT m.config, r.roc_auc AS real_value, count(m.roc_auc) AS null_n, avg(m.roc_auc) AS null_mean, stddev_samp(m.roc_auc) AS null_std,
       quantile_cont(m.roc_auc, 0.05) AS null_q05, quantile_cont(m.roc_auc, 0.5) AS null_q50, quantile_cont(m.roc_auc, 0.95) AS null_q95,
       (count(*) FILTER (round(m.roc_auc, 12) >= round(r.roc_auc, 12)) + 1) / CAST(count(m.roc_auc) + 1 AS DOUBLE) AS p_value
FROM null_metrics m JOIN real_metric r ON r.config = m.config GROUP BY m.config, r.roc_auc
"""


def null_summary(spark, d, n_perm=N_PERM):
    p = V.preds(spark, d).select("sample_id", "user_key", "y_true", "y_prob")
    null = RS.permuted_roc(p, "user_key", "sample_id", "y_true", "y_prob", 0, n_perm)
    null = null.withColumns({"config": F.lit("all"), "roc_auc": F.round("roc_auc", 12)})
    real = R.auc(p.withColumn("config", F.lit("all")), K).withColumn("roc_auc", F.round("roc_auc", 12))
    return RS.permutation_summary(null, real)


@query("agg_25_null_distribution", sql_rounded(NULL_COLS, NULL_SQL), "null_metrics real_metric")
def _(spark, d):
    return rounded(null_summary(spark, d))


@query("rsm_05_permutation_p_value", sql_rounded("p_value", f"SELECT config, p_value FROM ({NULL_SQL})"), "null_metrics real_metric")
def _(spark, d):
    return rounded(null_summary(spark, d).select("config", "p_value"))


# The counts of the study, beside the queries above with N_BOOT and N_PERM draws.
ROW_BOOT, USER_BOOT, USER_PERM = 2000, 1000, 200
cte("row_draws_study", "row_numbers", f"""
SELECT n.config, n.draw, CAST(('0x' || substr(md5('42:' || n.draw || ':' || n.idx), 1, 15)) AS BIGINT) % n.size AS idx
FROM (SELECT *, unnest(range({ROW_BOOT})) AS draw FROM row_numbers) n
""")
cte("row_resamples_study", "row_draws_study row_numbers",
    draw_metrics("(SELECT d.config, d.draw, r.y_prob, r.y_true FROM row_draws_study d JOIN row_numbers r USING (config, idx))"))
cte("user_resamples_study", "user_numbers", draw_metrics(f"""(
  SELECT n.config, n.draw, p.y_prob, p.y_true
  FROM (SELECT *, unnest(range({USER_BOOT})) AS draw FROM user_numbers) n
  JOIN user_numbers u ON u.config = n.config AND u.idx = CAST(('0x' || substr(md5('42:' || n.draw || ':' || n.idx), 1, 15)) AS BIGINT) % n.size
  JOIN preds p ON p.config = u.config AND p.user_key = u.user_key)"""))
cte("null_draws_study", "preds", f"""
SELECT g.perm, r.y_prob, l.y_true AS y_true_perm
FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY sample_id) AS rn FROM preds) r
JOIN (SELECT user_key, row_number() OVER (ORDER BY md5('users:' || user_key), user_key) AS place FROM (SELECT DISTINCT user_key FROM preds)) t ON t.user_key = r.user_key
JOIN (SELECT *, row_number() OVER (PARTITION BY perm ORDER BY md5('0:' || perm || ':' || user_key), user_key) AS place
      FROM (SELECT user_key, count(*) AS n, unnest(range({USER_PERM})) AS perm FROM preds GROUP BY user_key)) g ON g.place = t.place
JOIN (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY sample_id) AS rn FROM preds) l ON l.user_key = g.user_key AND l.rn = (r.rn - 1) % g.n + 1
""")
cte("null_metrics_study", "null_draws_study", draw_metrics("(SELECT 'all' AS config, perm AS draw, y_prob, y_true_perm AS y_true FROM null_draws_study)"))


@query(
    "rsm_01_row_bootstrap_ci_study",
    sql_rounded(CI, """SELECT a.config, a.n, a.pos, CASE WHEN a.pos BETWEEN 1 AND a.n - 1 AND a.n >= 5 THEN a.roc_auc END AS roc_auc,
         CASE WHEN a.pos BETWEEN 1 AND a.n - 1 AND a.n >= 5 THEN a.pr_auc END AS pr_auc, quantile_cont(r.roc_auc, 0.025) AS roc_auc_lo, quantile_cont(r.roc_auc, 0.975) AS roc_auc_hi,
         quantile_cont(r.pr_auc, 0.025) FILTER (r.roc_auc IS NOT NULL) AS pr_auc_lo, quantile_cont(r.pr_auc, 0.975) FILTER (r.roc_auc IS NOT NULL) AS pr_auc_hi
       FROM aucs a JOIN row_resamples_study r ON r.config = a.config GROUP BY ALL"""),
    "aucs row_resamples_study",
)
def _(spark, d):
    return rounded(RS.bootstrap_ci(V.preds(spark, d), K, "sample_id", ROW_BOOT))


@query("rsm_01_tree_bootstrap_ci_study")
def _(spark, d):
    return rounded(RS.tree_bootstrap_ci(V.preds(spark, d), K, ROW_BOOT))


@query("rsm_02_cluster_bootstrap_study", sql_rounded("roc_auc pr_auc", "SELECT * FROM user_resamples_study"), "user_resamples_study preds")
def _(spark, d):
    return rounded(RS.cluster_bootstrap(V.preds(spark, d), K, "user_key", USER_BOOT)).withColumn("draw", F.col("draw").cast("bigint"))


@query("rsm_02_tree_cluster_bootstrap_study")
def _(spark, d):
    return rounded(splittree.user_bootstrap(V.preds(spark, d), K, "user_key", USER_BOOT)).withColumn("draw", F.col("draw").cast("bigint"))


@query("evl_17_tree_panel_with_interval_study")
def _(spark, d):
    p = V.preds(spark, d)
    ci = RS.interval(splittree.user_bootstrap(p, K, "user_key", USER_BOOT), K, ["roc_auc"])
    return rounded(R.panel(p, K).join(ci, K, "left").select(
        "config", "f1", "roc_auc", "pr_auc", F.col("roc_auc_lo").alias("auc_ci_lo"), F.col("roc_auc_hi").alias("auc_ci_hi")
    ))


@query(
    "evl_17_panel_with_interval_study",
    sql_rounded("f1 roc_auc pr_auc auc_ci_lo auc_ci_hi", """SELECT c.config, c.f1, a.roc_auc, CASE WHEN a.pos BETWEEN 1 AND a.n - 1 THEN a.pr_auc END AS pr_auc, quantile_cont(u.roc_auc, 0.025) AS auc_ci_lo, quantile_cont(u.roc_auc, 0.975) AS auc_ci_hi
       FROM confusion c JOIN aucs a USING (config) JOIN user_resamples_study u ON u.config = c.config GROUP BY ALL"""),
    "confusion aucs user_resamples_study",
)
def _(spark, d):
    p = V.preds(spark, d)
    ci = RS.interval(RS.cluster_bootstrap(p, K, "user_key", USER_BOOT), K, ["roc_auc"])
    return rounded(R.panel(p, K).join(ci, K, "left").select(
        "config", "f1", "roc_auc", "pr_auc", F.col("roc_auc_lo").alias("auc_ci_lo"), F.col("roc_auc_hi").alias("auc_ci_hi")
    ))


NULL_STUDY_SQL = """
SELECT m.config, r.roc_auc AS real_value, count(m.roc_auc) AS null_n, avg(m.roc_auc) AS null_mean, stddev_samp(m.roc_auc) AS null_std,
       quantile_cont(m.roc_auc, 0.05) AS null_q05, quantile_cont(m.roc_auc, 0.5) AS null_q50, quantile_cont(m.roc_auc, 0.95) AS null_q95,
       (count(*) FILTER (round(m.roc_auc, 12) >= round(r.roc_auc, 12)) + 1) / CAST(count(m.roc_auc) + 1 AS DOUBLE) AS p_value
FROM null_metrics_study m JOIN real_metric r ON r.config = m.config GROUP BY m.config, r.roc_auc
"""


@query(
    "agg_25_null_distribution_study",
    sql_rounded(NULL_COLS, NULL_STUDY_SQL), "null_metrics_study real_metric",
)
def _(spark, d):
    return rounded(null_summary(spark, d, USER_PERM))


@query(
    "rsm_05_permutation_p_value_study", sql_rounded("p_value", f"SELECT config, p_value FROM ({NULL_STUDY_SQL})"),
    "null_metrics_study real_metric",
)
def _(spark, d):
    return rounded(null_summary(spark, d, USER_PERM).select("config", "p_value"))


# --- joins between result tables ------------------------------------------------------------------

GRID = ["threshold", "input_length_days", "washout_days"]
GRID_SQL = ", ".join(GRID)
DELTAS = "v1_best_val_pr_auc v1_best_val_roc_auc val_pr_auc_delta val_roc_auc_delta"
MATCH_SQL = f"""SELECT b.algo, {', '.join('b.' + g for g in GRID)}, b.val_pr_auc, b.val_roc_auc, o.v1_best_val_pr_auc, o.v1_best_val_roc_auc,
       b.val_pr_auc - o.v1_best_val_pr_auc AS val_pr_auc_delta, b.val_roc_auc - o.v1_best_val_roc_auc AS val_roc_auc_delta
FROM best b LEFT JOIN (SELECT {GRID_SQL}, max(val_pr_auc) AS v1_best_val_pr_auc, max(val_roc_auc) AS v1_best_val_roc_auc
  FROM trials WHERE seed < 2 AND washout_days > 0 GROUP BY ALL) o USING ({GRID_SQL})"""


def matched(spark, d):
    t = V.trials(spark, d)
    metrics = ["val_pr_auc", "val_roc_auc"]
    winners = select.best_trials(t, ["algo"]).select("algo", *GRID, *metrics)
    return select.grid_match(winners, t.filter("seed < 2 and washout_days > 0"), GRID, metrics)


@query("jon_12_grid_match", sql_rounded(DELTAS, MATCH_SQL), "best trials")
def _(spark, d):
    out = matched(spark, d)
    return out.withColumns({c: rounded_gap(c) for c in DELTAS.split()})


@query("rpt_05_version_deltas", sql_rounded("val_pr_auc_delta val_roc_auc_delta", f"SELECT algo, val_pr_auc_delta, val_roc_auc_delta FROM ({MATCH_SQL})"), "best trials")
def _(spark, d):
    return rounded(matched(spark, d).select("algo", "val_pr_auc_delta", "val_roc_auc_delta"))


@query(
    "jon_13_compare_reported",
    sql_rounded("test_f1_diff test_f1_new test_f1_reported", """SELECT a.algo, a.f AS test_f1_new, b.f AS test_f1_reported, a.f - b.f AS test_f1_diff
       FROM (SELECT algo, avg(test_f1) AS f FROM trials WHERE seed < 3 GROUP BY algo) a JOIN (SELECT algo, avg(test_f1) AS f FROM trials WHERE seed >= 3 GROUP BY algo) b USING (algo)"""),
    "trials",
)
def _(spark, d):
    t = V.trials(spark, d)
    mean = F.avg("test_f1").alias("test_f1")
    new = t.filter("seed < 3").groupBy("algo").agg(mean)
    old = t.filter("seed >= 3").groupBy("algo").agg(mean)
    return rounded(reports.compare_with_reported(new, old, "algo", ["test_f1"]))


@query(
    "jon_14_semi_by_cell",
    f"SELECT trial_id, {GRID_SQL} FROM trials WHERE ({GRID_SQL}) IN (SELECT {GRID_SQL} FROM best)",
    "trials best",
)
def _(spark, d):
    t = V.trials(spark, d)
    cells = select.best_trials(t, ["algo"]).select(*GRID)
    return t.select("trial_id", *GRID).join(cells, GRID, "left_semi")


@query(
    "jon_17_winner_lookup",
    sql_rounded("test_mean test_sd", f"""SELECT b.algo, {', '.join('b.' + g for g in GRID)}, f.test_mean, f.test_sd, c.lo, c.hi
       FROM best b LEFT JOIN (SELECT algo, {GRID_SQL}, avg(test_roc_auc) AS test_mean, stddev_samp(test_roc_auc) AS test_sd FROM trials GROUP BY ALL) f USING (algo, {GRID_SQL})
       LEFT JOIN (SELECT algo, {GRID_SQL}, min(test_roc_auc) AS lo, max(test_roc_auc) AS hi FROM trials GROUP BY ALL) c USING (algo, {GRID_SQL})"""),
    "best trials",
)
def _(spark, d):
    t = V.trials(spark, d)
    keys = ["algo", *GRID]
    winners = select.best_trials(t, ["algo"]).select(*keys)
    full = t.groupBy(*keys).agg(F.avg("test_roc_auc").alias("test_mean"), F.stddev_samp("test_roc_auc").alias("test_sd"))
    ci = t.groupBy(*keys).agg(F.min("test_roc_auc").alias("lo"), F.max("test_roc_auc").alias("hi"))
    out = reports.winners_with_intervals(winners, full, ci, keys)
    return out.withColumns({c: rounded_gap(c) for c in ("test_mean", "test_sd")})


@query(
    "jon_18_grid_product",
    """SELECT t.algo, g.length_days, g.washout, count(*) AS trials_in_cell, count(*) FILTER (t.input_length_days = g.length_days AND t.washout_days = g.washout) AS matching
       FROM trials t, (SELECT l AS length_days, w AS washout FROM (SELECT unnest([7, 14, 28]) AS l), (SELECT unnest([0, 7, 14]) AS w)) g GROUP BY ALL""",
    "trials",
)
def _(spark, d):
    # The grid is a constant array that is exploded per pre-aggregated row, not a join.
    counts = V.trials(spark, d).groupBy("algo", "input_length_days", "washout_days").agg(F.count("*").alias("n"))
    cells = [F.struct(F.lit(n).alias("length_days"), F.lit(w).alias("washout")) for n in (7, 14, 28) for w in (0, 7, 14)]
    laid = counts.select("*", F.explode(F.array(*cells)).alias("c")).select("*", "c.*")
    here = (F.col("input_length_days") == F.col("length_days")) & (F.col("washout_days") == F.col("washout"))
    return laid.groupBy("algo", "length_days", "washout").agg(
        F.sum("n").alias("trials_in_cell"), F.sum(F.when(here, F.col("n")).otherwise(0)).alias("matching")
    )


# --- result tables --------------------------------------------------------------------------------

SEEDED = "train_pr_auc val_pr_auc train_val_pr_auc_gap test_pr_auc val_test_pr_auc_gap test_roc_auc test_f1".split()
SEEDED_COLS = [f"{m}_mean" for m in SEEDED] + ["test_pr_auc_std", "overfit_gap_rate"]
cte("seeded", "diagnosed", f"""
SELECT algo, {GRID_SQL}, {', '.join(f'avg({m}) AS {m}_mean' for m in SEEDED)}, stddev_samp(test_pr_auc) AS test_pr_auc_std,
       avg(CAST(overfit_gap_flag AS INTEGER)) AS overfit_gap_rate, count(seed) AS n_seeds FROM diagnosed GROUP BY ALL
""")


@query("agg_29_seeded_final_rows", sql_rounded(SEEDED_COLS, "SELECT * FROM seeded"), "seeded")
def _(spark, d):
    return rounded(reports.seeded_families(select.diagnostics(V.trials(spark, d)), "algo"))


HEAD = ["train_pr_auc", "val_pr_auc", "train_val_pr_auc_gap", "val_recall_at_precision_floor", "val_precision_at_recall_floor",
        "test_pr_auc", "val_test_pr_auc_gap", "test_roc_auc", "test_f1"]


@query(
    "rpt_01_headline",
    sql_rounded([*HEAD, "test_pr_auc_std", "overfit_gap_rate"], f"""SELECT 'tabular' AS family, algo AS name, {GRID_SQL}, 'val_pr_auc' AS selection_metric, {', '.join(HEAD)},
         overfit_gap_flag, low_val_event_detection_flag, NULL AS test_pr_auc_std, NULL AS overfit_gap_rate, NULL AS n_seeds FROM best
       UNION ALL BY NAME SELECT 'seeded' AS family, algo AS name, {GRID_SQL}, 'val_pr_auc_mean' AS selection_metric, {', '.join(f'{m}_mean AS {m}' for m in SEEDED)},
         test_pr_auc_std, overfit_gap_rate, n_seeds FROM seeded"""),
    "best seeded",
)
def _(spark, d):
    t = select.diagnostics(V.trials(spark, d))
    return rounded(reports.headline(t, t))


BASELINE = ("locked_baseline", 0.44, 0.05, 5)
RANK_SQL = f"""
SELECT experiment, family, round(roc_auc_mean - {BASELINE[1]}, 4) + 0 AS delta_auc, n_seeds, round(roc_auc_mean, 4) AS roc_auc_mean,
       round(roc_auc_std, 4) AS roc_auc_std, round(pr_auc_mean, 4) AS pr_auc_mean, round(f1_mean, 4) AS f1_mean FROM (
  SELECT 'run_' || algo AS experiment, 'Tabular' AS family, count(*) AS n_seeds, avg(test_roc_auc) AS roc_auc_mean,
         stddev_samp(test_roc_auc) AS roc_auc_std, avg(test_pr_auc) AS pr_auc_mean, avg(test_f1) AS f1_mean FROM trials GROUP BY algo
  UNION ALL SELECT '{BASELINE[0]}', 'Baseline', {BASELINE[3]}, {BASELINE[1]}, {BASELINE[2]}, NULL, NULL)
"""


@query("rpt_02_experiment_ranking", RANK_SQL, "trials")
def _(spark, d):
    agg = select.mean_std(AG.experiments(spark, d), ["model"], ["roc_auc", "pr_auc", "f1"])
    part = agg.withColumns({"experiment": F.concat(F.lit("run_"), "model"), "family": F.lit("Tabular")}).drop("model")
    return reports.experiment_ranking([part, None], BASELINE)


@query(
    "rpt_03_tier_headline",
    sql_rounded("test_roc_auc", """SELECT algo, 'multi_seed' AS origin, avg(test_roc_auc) AS test_roc_auc FROM trials WHERE n_features > 20 AND algo < 'm' GROUP BY algo
       UNION ALL SELECT algo, 'single', max(test_roc_auc) FROM trials
         WHERE algo NOT IN (SELECT algo FROM trials WHERE n_features > 20 AND algo < 'm') GROUP BY algo"""),
    "trials",
)
def _(spark, d):
    t = V.trials(spark, d)
    seeded = t.filter("n_features > 20 and algo < 'm'").groupBy("algo").agg(F.avg("test_roc_auc").alias("test_roc_auc"))
    single = t.groupBy("algo").agg(F.max("test_roc_auc").alias("test_roc_auc"))
    return rounded(reports.tier_headline(single, seeded, ["algo"]))


LISTINGS = {
    "sample_counts": ("threshold input_length_days washout_days n", [("threshold", False), ("input_length_days", False), ("washout_days", False)]),
    "best_rows": ("algo trial_id val_pr_auc test_pr_auc", [("val_pr_auc", True), ("trial_id", False)]),
}


@query(
    "rpt_04_listing_best_rows",
    "SELECT algo, trial_id, val_pr_auc, test_pr_auc FROM best ORDER BY val_pr_auc DESC NULLS LAST, trial_id",
    "best",
)
def _(spark, d):
    columns, order = LISTINGS["best_rows"]
    return reports.listing(select.best_trials(V.trials(spark, d), ["algo"]), columns.split(), order)


@query(
    "rpt_04_listing_cell_counts",
    f"SELECT {GRID_SQL}, count(*) AS n FROM trials GROUP BY ALL ORDER BY {GRID_SQL}",
    "trials",
)
def _(spark, d):
    columns, order = LISTINGS["sample_counts"]
    counts = V.trials(spark, d).groupBy(*GRID).agg(F.count("*").alias("n"))
    return reports.listing(counts, columns.split(), order)


# --- model combinations that need no fit ----------------------------------------------------------


@query(
    "mod_04_majority_baseline",
    """SELECT sample_id, target, (SELECT target FROM (SELECT target, count(*) AS n FROM vectors WHERE user_key < 9 GROUP BY target ORDER BY n DESC, target LIMIT 1)) AS y_pred
       FROM vectors WHERE user_key >= 9""",
    "vectors",
)
def _(spark, d):
    v = V.vectors(spark, d).select("sample_id", "user_key", "target")
    out = M.majority_baseline(v.filter("user_key < 9"), v.filter("user_key >= 9"))
    return out.select("sample_id", "target", "y_pred")


MODEL_SQL = "SELECT config, sample_id, y_true, 'a' AS model, y_prob FROM preds UNION ALL SELECT config, sample_id, y_true, 'b', 1 - y_prob * y_prob FROM preds"


def two_models(spark, d):
    p = V.preds(spark, d).select("config", "sample_id", "y_true", "y_prob")
    prob = F.col("y_prob")
    a = p.withColumn("model", F.lit("a"))
    return a.unionByName(p.withColumns({"model": F.lit("b"), "y_prob": 1 - prob * prob}))


@query(
    "mod_06_weighted_ensemble",
    sql_rounded("y_prob", f"""SELECT sample_id, max(y_true) AS y_true, sum(CASE model WHEN 'a' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * y_prob) AS y_prob FROM ({MODEL_SQL}) GROUP BY sample_id"""),
    "preds",
)
def _(spark, d):
    return rounded(M.ensemble(two_models(spark, d), ["sample_id"], "model", {"a": 0.6, "b": 0.4}))


@query(
    "mod_06_auc_weighted_ensemble",
    sql_rounded("y_prob", f"""WITH m AS ({MODEL_SQL}), w AS (SELECT model, greatest(roc_auc, 0.5) AS weight FROM (
         SELECT config AS model, roc_auc FROM ({draw_metrics("(SELECT model AS config, 0 AS draw, y_prob, y_true FROM m WHERE sample_id % 2 = 0)")}))
       ) SELECT sample_id, max(y_true) AS y_true, sum(weight * y_prob) / sum(weight) AS y_prob FROM m JOIN w USING (model) GROUP BY sample_id"""),
    "preds",
)
def _(spark, d):
    both = two_models(spark, d)
    # The even ids stand for the validation rows that set the weights; all rows are scored.
    weights = M.auc_weights(both.filter(F.col("sample_id") % 2 == 0), "model")
    return rounded(M.ensemble(both, ["sample_id"], "model", weights))
