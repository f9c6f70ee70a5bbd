"""Profiles and summaries over raw tables and trial tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.catalogue import labelling as LB
from cohortlake.catalogue.common import minutes, rounded, sql_rounded
from cohortlake.catalogue.ctes import cte
from cohortlake.catalogue.registry import query
from cohortlake.operators import daily as D, profile, select
from cohortlake.operators.ordering import exact_quantiles
from cohortlake.plans import labels as L
from cohortlake.sources import schemas as S, standin as V

WEEKLY_COLUMNS = ["user_key", "date", *S.SYMPTOM_COLUMNS, *S.DIRECT_EVENT_FIELDS, "weekly_oral"]
RAW = {"user_key": "bigint", "date": "int", "time": "string", "activity_type": "double", "intensity": "double", "steps": "double", "hr": "double"}


@query(
    "agg_12_column_profile",
    sql_rounded("missing_pct", " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS missing_count,
            count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*) AS missing_pct, count(DISTINCT {c}) AS n_unique, '{t}' AS dtype FROM raw_minutes"""
        for c, t in RAW.items())),
    "raw_minutes",
)
def _(spark, d):
    return rounded(profile.column_profile(V.raw_minutes(spark, d)))


@query(
    "agg_13_user_profile",
    sql_rounded("missing_pct", """SELECT user_key, count(*) AS rows, min(date) AS first_day, max(date) AS last_day,
         count(DISTINCT date) AS days, max(date) - min(date) + 1 AS span_days, avg(CAST(hr IS NULL AS INTEGER)) * 100 AS missing_pct
       FROM raw_minutes GROUP BY user_key"""),
    "raw_minutes",
)
def _(spark, d):
    return rounded(profile.user_profile(V.raw_minutes(spark, d), "user_key", "date", "hr"))


@query(
    "agg_14_cleaning_log",
    """SELECT 'rows_after_cleaning' AS metric, CAST(count(*) AS DOUBLE) AS value FROM minutes
       UNION ALL SELECT 'unique_users', CAST(count(DISTINCT user_key) AS DOUBLE) FROM minutes
       UNION ALL SELECT 'missing_hr_pct', round(avg(CAST(hr IS NULL AS INTEGER)) * 100, 2) FROM minutes
       UNION ALL SELECT 'missing_steps_pct', round(avg(CAST(steps IS NULL AS INTEGER)) * 100, 2) FROM minutes""",
    "minutes",
)
def _(spark, d):
    return D.cleaning_log(minutes(spark, d))


@query(
    "agg_16_value_share",
    sql_rounded("pct", "SELECT event_type, count(*) AS count, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM ev GROUP BY event_type"),
    "ev",
)
def _(spark, d):
    return rounded(profile.value_share(V.table(spark, d, "events").select("event_type"), "event_type"))


FLAGS = L.V1_FLAGS
PAIRS = [(a, b) for i, a in enumerate(FLAGS) for b in FLAGS[i + 1:]]


@query(
    "agg_26_flag_audit",
    sql_rounded("pct", " UNION ALL ".join(
        f"SELECT '{f}' AS flag, CAST(sum(CAST({f} AS INTEGER)) AS BIGINT) AS count, avg(CAST({f} AS INTEGER)) * 100 AS pct FROM weekly_targets" for f in FLAGS)),
    "weekly_targets",
)
def _(spark, d):
    return rounded(profile.flag_audit(L.weekly_targets(V.weekly(spark, d)), FLAGS))


@query(
    "agg_26_flag_correlations",
    sql_rounded("corr", " UNION ALL ".join(
        f"""SELECT '{a}' AS flag_a, '{b}' AS flag_b, CASE WHEN stddev_pop(CAST({a} AS INTEGER)) > 0 AND stddev_pop(CAST({b} AS INTEGER)) > 0
            THEN corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END AS corr FROM weekly_targets""" for a, b in PAIRS)),
    "weekly_targets",
)
def _(spark, d):
    return rounded(profile.flag_correlations(L.weekly_targets(V.weekly(spark, d)), FLAGS))


RULES = {
    "any_symptom": " OR ".join(f"{c} >= 4" for c in S.SYMPTOM_COLUMNS),
    "wheeze_5": "weekly_wheeze >= 5",
    "relief_5": "weekly_relief_inhaler >= 5",
    "steroid": "weekly_oral >= 3",
    "sum_above_p90": "symptom_sum > p90",
}
SYMPTOM_SUM = " + ".join(S.SYMPTOM_COLUMNS)
RULE_SQL = " UNION ALL ".join(
    f"""SELECT '{n}' AS rule, count(*) FILTER ({r}) AS positives, count(DISTINCT user_key) FILTER ({r}) AS users_with_positives,
        count(*) FILTER ({r}) / CAST(count(*) AS DOUBLE) AS rate FROM scored""" for n, r in RULES.items())


@query(
    "agg_27_rule_sweep",
    sql_rounded("rate", f"""WITH scored AS (SELECT *, {SYMPTOM_SUM} AS symptom_sum, (SELECT quantile_cont(CAST({SYMPTOM_SUM} AS DOUBLE), 0.9) FROM weekly) AS p90 FROM weekly)
        SELECT * FROM ({RULE_SQL})"""),
    "weekly",
)
def _(spark, d):
    scored = V.weekly(spark, d).withColumn("symptom_sum", F.expr(SYMPTOM_SUM))
    cut = exact_quantiles(scored, [], "symptom_sum", {"p90": 0.9}).first()["p90"]
    rules = {n: F.expr(r) for n, r in RULES.items() if n != "sum_above_p90"}
    rules["sum_above_p90"] = F.col("symptom_sum") > cut
    return rounded(profile.rule_sweep(scored, rules, "user_key"))


@query(
    "agg_30_quality_counts",
    """SELECT 'negative_date' AS metric, count(*) FILTER (date < 0) AS value FROM raw_minutes
       UNION ALL SELECT 'negative_steps', count(*) FILTER (steps < 0) FROM raw_minutes
       UNION ALL SELECT 'nonpositive_hr', count(*) FILTER (hr <= 0) FROM raw_minutes
       UNION ALL SELECT 'duplicate_rows', (SELECT count(*) FROM raw_minutes) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_minutes))""",
    "raw_minutes",
)
def _(spark, d):
    checks = {"negative_date": F.col("date") < 0, "negative_steps": F.col("steps") < 0, "nonpositive_hr": F.col("hr") <= 0}
    return profile.quality_counts(V.raw_minutes(spark, d), checks)


@query(
    "agg_31_missing_share",
    sql_rounded("missing_pct", " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", avg(CAST({c} IS NULL AS INTEGER)) * 100 AS missing_pct FROM weekly""" for c in WEEKLY_COLUMNS)),
    "weekly",
)
def _(spark, d):
    return rounded(profile.missing_share(V.weekly(spark, d)))


@query(
    "agg_31_score_histogram",
    " UNION ALL ".join(f"SELECT '{c}' AS symptom, CAST({c} AS INTEGER) AS score, count(*) AS n FROM weekly GROUP BY ALL" for c in S.SYMPTOM_COLUMNS),
    "weekly",
)
def _(spark, d):
    scores = [F.col(c).cast("int").alias(c) for c in S.SYMPTOM_COLUMNS]
    long = V.weekly(spark, d).select(*scores).unpivot([], S.SYMPTOM_COLUMNS, "symptom", "score")
    return long.groupBy("symptom", "score").agg(F.count("*").alias("n"))


# --- summaries of trial tables --------------------------------------------------------------------

CELL = ["algo", "threshold", "input_length_days", "washout_days"]
METRICS = ["val_pr_auc", "test_pr_auc", "test_roc_auc"]


def _stats(m: str) -> str:
    return (f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max, "
            f"quantile_cont({m}, 0.5) AS {m}_median")


SEED_COLS = [f"{m}_{s}" for m in METRICS for s in ("mean", "std", "min", "max", "median")]


@query(
    "agg_20_seed_summary",
    sql_rounded(SEED_COLS, f"SELECT {', '.join(CELL)}, {', '.join(_stats(m) for m in METRICS)} FROM trials GROUP BY ALL", 4),
    "trials",
)
def _(spark, d):
    return rounded(select.seed_summary(V.trials(spark, d), CELL, METRICS, digits=9), 4)


@query(
    "agg_21_experiment_mean_std",
    sql_rounded("roc_auc_mean roc_auc_std pr_auc_mean pr_auc_std f1_mean f1_std", """SELECT algo AS model, subset, avg(test_roc_auc) AS roc_auc_mean, stddev_samp(test_roc_auc) AS roc_auc_std,
         avg(test_pr_auc) AS pr_auc_mean, stddev_samp(test_pr_auc) AS pr_auc_std, avg(test_f1) AS f1_mean, stddev_samp(test_f1) AS f1_std, count(*) AS n_seeds
       FROM trials GROUP BY algo, subset"""),
    "trials",
)
def _(spark, d):
    return rounded(select.mean_std(experiments(spark, d), ["model", "subset"], ["roc_auc", "pr_auc", "f1", "auc_ci_lo", "auc_ci_hi"]))


def experiments(spark, d):
    return V.trials(spark, d).select(
        F.col("algo").alias("model"), "subset", "seed", F.col("test_roc_auc").alias("roc_auc"),
        F.col("test_pr_auc").alias("pr_auc"), F.col("test_f1").alias("f1"),
    )


cte("probes", "trials", """
SELECT algo, threshold, input_length_days, washout_days, avg(val_roc_auc) AS val_roc_auc_mean, stddev_samp(val_roc_auc) AS val_roc_auc_std,
       avg(val_pr_auc) AS val_pr_auc_mean, stddev_samp(val_pr_auc) AS val_pr_auc_std, count(*) AS n_shuffles
FROM trials GROUP BY ALL
""")
PROBE = ["val_roc_auc_mean", "val_roc_auc_std", "val_pr_auc_mean", "val_pr_auc_std"]


def probes(spark, d):
    return V.trials(spark, d).groupBy(*CELL).agg(
        F.avg("val_roc_auc").alias("val_roc_auc_mean"), F.stddev_samp("val_roc_auc").alias("val_roc_auc_std"),
        F.avg("val_pr_auc").alias("val_pr_auc_mean"), F.stddev_samp("val_pr_auc").alias("val_pr_auc_std"),
        F.count("*").alias("n_shuffles"),
    )


@query("agg_22_probe_summary", sql_rounded(PROBE, "SELECT * FROM probes"), "probes")
def _(spark, d):
    return rounded(probes(spark, d))


@query(
    "agg_23_probe_overall",
    sql_rounded("val_roc_auc_mean_overall val_roc_auc_std_overall val_pr_auc_mean_overall", """SELECT count(*) AS n_configs,
         avg(val_roc_auc_mean) AS val_roc_auc_mean_overall, stddev_samp(val_roc_auc_mean) AS val_roc_auc_std_overall,
         count(*) FILTER (round(val_roc_auc_mean, 9) < 0.4 OR round(val_roc_auc_mean, 9) > 0.6) AS n_outside, avg(val_pr_auc_mean) AS val_pr_auc_mean_overall FROM probes"""),
    "probes",
)
def _(spark, d):
    mean = F.round("val_roc_auc_mean", 9)
    return rounded(probes(spark, d).agg(
        F.count("*").alias("n_configs"), F.avg("val_roc_auc_mean").alias("val_roc_auc_mean_overall"),
        F.stddev_samp("val_roc_auc_mean").alias("val_roc_auc_std_overall"),
        F.count_if((mean < 0.4) | (mean > 0.6)).alias("n_outside"), F.avg("val_pr_auc_mean").alias("val_pr_auc_mean_overall"),
    ))


@query(
    "win_10_row_differences",
    """SELECT user_key, min(step) AS smallest_step, max(step) AS largest_step, min(step) >= 0 AS monotone FROM (
         SELECT user_key, anchor_relative_minute - lag(anchor_relative_minute) OVER (PARTITION BY user_key ORDER BY anchor_relative_minute) AS step
         FROM labelled) GROUP BY user_key""",
    "labelled",
)
def _(spark, d):
    from pyspark.sql import Window as W

    # Anchors are distinct per user and bounded by the study's days, so the ordered window stays small.
    at = F.col("anchor_relative_minute")
    step = at - F.lag(at).over(W.partitionBy("user_key").orderBy(at))
    rows = LB.labelled(spark, d).select("user_key", step.alias("step"))
    return rows.groupBy("user_key").agg(
        F.min("step").alias("smallest_step"), F.max("step").alias("largest_step"), (F.min("step") >= 0).alias("monotone")
    )
