"""Labels: weekly targets, as-of labels, event weeks, probable days, episodes and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.catalogue import derived as Q  # noqa: F401  (registers the shared CTEs)
from cohortlake.catalogue.common import (
    episodes,
    label_tables,
    minutes,
    probable_days,
    rounded,
    sql_rounded,
    week_scores,
)
from cohortlake.catalogue.ctes import cte
from cohortlake.catalogue.registry import query
from cohortlake.functions import exprs as E
from cohortlake.operators import timejoin, windows as WN
from cohortlake.operators.profile import user_rates
from cohortlake.plans import labels as L, samples as P
from cohortlake.sources import schemas as S, standin as V
from cohortlake.sources.tables import materialize, scratch_dir, write_parquet

T, LENGTHS, WASHOUTS = (2, 3, 4), (3, 7, 14), (0, 7, 14)
FLAGS = ", ".join(L.V1_FLAGS)

cte("weekly_targets", "weekly", """
SELECT *, CAST(doc_flag OR hospital_flag OR er_flag OR oral_flag OR symptom_flag AS INTEGER) AS target_binary,
       date AS week_end_day, date + 1 AS questionnaire_day, CAST((date + 1) * 1440 AS BIGINT) AS questionnaire_relative_minute
FROM (
  SELECT DISTINCT user_key, date, CAST(weekly_night_symp AS DOUBLE) AS weekly_night_symp,
    CAST(weekly_day_symp AS DOUBLE) AS weekly_day_symp, CAST(weekly_limit_activity AS DOUBLE) AS weekly_limit_activity,
    CAST(weekly_short_breath AS DOUBLE) AS weekly_short_breath, CAST(weekly_wheeze AS DOUBLE) AS weekly_wheeze,
    CAST(weekly_relief_inhaler AS DOUBLE) AS weekly_relief_inhaler, trim(coalesce(weekly_doc, '0')) AS weekly_doc,
    TRY_CAST(weekly_hospital AS DOUBLE) AS weekly_hospital, TRY_CAST(weekly_er AS DOUBLE) AS weekly_er,
    CAST(weekly_oral AS DOUBLE) AS weekly_oral,
    trim(coalesce(weekly_doc, '0')) <> '0' AS doc_flag, coalesce(TRY_CAST(weekly_hospital AS DOUBLE), 0) > 0 AS hospital_flag,
    coalesce(TRY_CAST(weekly_er AS DOUBLE), 0) > 0 AS er_flag, coalesce(weekly_oral, 0) >= 3 AS oral_flag,
    CAST(weekly_day_symp >= 4 AS INTEGER) + CAST(weekly_night_symp >= 3 AS INTEGER) + CAST(weekly_short_breath >= 4 AS INTEGER)
      + CAST(weekly_wheeze >= 4 AS INTEGER) + CAST(weekly_relief_inhaler >= 4 AS INTEGER)
      + CAST(weekly_limit_activity >= 3 AS INTEGER) >= 3 AS symptom_flag
  FROM weekly)
""")
cte("anchors", "minutes", """
SELECT user_key, unnest(range(lo + 1440, hi + 1, 720)) AS anchor_relative_minute
FROM (SELECT user_key, min(relative_minute) AS lo, max(relative_minute) AS hi FROM minutes GROUP BY user_key)
WHERE lo + 1440 <= hi
""")
cte("labelled", "anchors weekly_targets", f"""
SELECT *, questionnaire_relative_minute - anchor_relative_minute AS time_to_label_minutes,
       (questionnaire_relative_minute - anchor_relative_minute) / 1440.0::DOUBLE AS time_to_label_days
FROM (SELECT a.*, w.questionnaire_relative_minute, w.target_binary, w.week_end_day, w.questionnaire_day, {FLAGS}
      FROM anchors a ASOF JOIN weekly_targets w
        ON a.user_key = w.user_key AND a.anchor_relative_minute < w.questionnaire_relative_minute)
WHERE questionnaire_relative_minute - anchor_relative_minute BETWEEN 0 AND 7 * 1440
""")


def anchors(spark, d):
    return WN.anchors(minutes(spark, d), 1440, 720)


def labelled(spark, d):
    return L.label_windows(anchors(spark, d), L.weekly_targets(V.weekly(spark, d)))


@query("pip_02_weekly_targets", "SELECT * FROM weekly_targets", "weekly_targets")
def _(spark, d):
    return L.weekly_targets(V.weekly(spark, d))


@query("jon_03_asof_forward", sql_rounded("time_to_label_days", "SELECT * FROM labelled"), "labelled")
def _(spark, d):
    return rounded(labelled(spark, d))


@query(
    "prj_19_horizon_filter",
    """SELECT user_key, count(*) AS kept, min(time_to_label_minutes) AS nearest, max(time_to_label_minutes) AS farthest
       FROM (SELECT a.user_key, w.questionnaire_relative_minute - a.anchor_relative_minute AS time_to_label_minutes
             FROM anchors a ASOF LEFT JOIN weekly_targets w
               ON a.user_key = w.user_key AND a.anchor_relative_minute < w.questionnaire_relative_minute)
       WHERE time_to_label_minutes BETWEEN 0 AND 3 * 1440 GROUP BY user_key""",
    "anchors weekly_targets",
)
def _(spark, d):
    near = L.label_windows(anchors(spark, d), L.weekly_targets(V.weekly(spark, d)), max_horizon_days=3)
    gap = F.col("time_to_label_minutes")
    return near.groupBy("user_key").agg(
        F.count(F.lit(1)).alias("kept"), F.min(gap).alias("nearest"), F.max(gap).alias("farthest")
    )


@query(
    "pip_03_window_label_job",
    sql_rounded("pct", "SELECT target_binary AS label, count(*) AS count, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM labelled GROUP BY 1"),
    "labelled",
)
def _(spark, d):
    path = f"{scratch_dir(spark)}/labelled"
    write_parquet(labelled(spark, d), path)
    return rounded(L.label_summary(spark.read.parquet(path)))


cte("onset_labelled", "anchors probable", """
SELECT *, next_event_day - end_day AS time_to_event_days,
       CAST(coalesce(next_event_day - end_day BETWEEN 1 AND 7, false) AS INTEGER) AS target_binary,
       7 AS horizon_days, 'event_onset_h7_t3' AS label_strategy
FROM (
  SELECT a.user_key, a.anchor_relative_minute, a.end_day,
         (SELECT min(p.event_day) FROM probable p WHERE p.threshold = 3 AND p.user_key = a.user_key AND p.event_day > a.end_day) AS next_event_day,
         greatest(max(a.end_day) OVER (PARTITION BY a.user_key),
           (SELECT max(p.event_day) FROM probable p WHERE p.threshold = 3 AND p.user_key = a.user_key)) AS known_until
  FROM (SELECT *, CAST(floor(anchor_relative_minute / 1440.0) - 1 AS INTEGER) AS end_day FROM anchors) a)
WHERE end_day + 7 <= known_until
""")
ONSET = "user_key, anchor_relative_minute, end_day, next_event_day, time_to_event_days, target_binary, horizon_days, label_strategy"


def onset_labelled(spark, d):
    days = probable_days(spark, d).filter("threshold = 3")
    return L.label_windows_by_onset(anchors(spark, d), days)


@query("jon_04_asof_censored", f"SELECT {ONSET} FROM onset_labelled", "onset_labelled")
def _(spark, d):
    return onset_labelled(spark, d)


@query(
    "pip_18_onset_label_job",
    sql_rounded("pct", "SELECT target_binary AS label, count(*) AS count, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM onset_labelled GROUP BY 1"),
    "onset_labelled",
)
def _(spark, d):
    path = f"{scratch_dir(spark)}/onset"
    write_parquet(onset_labelled(spark, d), path)
    return rounded(L.label_summary(spark.read.parquet(path)))


LAST_COLS = ", ".join(
    f"arg_max(w.{c}, w.date) FILTER (w.{c} IS NOT NULL) AS {c}" for c in S.SYMPTOM_COLUMNS
)


@query(
    "jon_05_asof_backward_last",
    f"""SELECT a.user_key, a.anchor_relative_minute, a.start_day, {LAST_COLS}
        FROM (SELECT *, CAST(floor((anchor_relative_minute - 1440) / 1440.0) AS INTEGER) AS start_day FROM anchors) a
        LEFT JOIN (SELECT * REPLACE (CASE WHEN weekly_wheeze <> 3 THEN weekly_wheeze END AS weekly_wheeze) FROM weekly) w
          ON a.user_key = w.user_key AND w.date < a.start_day
        GROUP BY a.user_key, a.anchor_relative_minute, a.start_day""",
    "anchors weekly",
)
def _(spark, d):
    left = anchors(spark, d).withColumn("start_day", E.window_first_day("anchor_relative_minute"))
    wheeze = F.col("weekly_wheeze")
    weekly = V.weekly(spark, d).withColumn("weekly_wheeze", F.when(wheeze != 3, wheeze))
    return timejoin.nearest_row(
        left, weekly, ["user_key"], "start_day", "date", S.SYMPTOM_COLUMNS, forward=False, per_column=True
    )


@query("jon_06_scores_in_positive_weeks", "SELECT * FROM week_scores", "week_scores")
def _(spark, d):
    return week_scores(spark, d)


@query("pip_04_weekly_events", "SELECT * FROM weekly_events", "weekly_events")
def _(spark, d):
    return L.weekly_events(V.weekly(spark, d))


@query(
    "prj_22_coverage_flag",
    """SELECT user_key, date, week_start_day, week_end_day, has_valid_covered_days FROM weekly_events""",
    "weekly_events",
)
def _(spark, d):
    cols = ["user_key", "date", "week_start_day", "week_end_day", "has_valid_covered_days"]
    return L.weekly_events(V.weekly(spark, d)).select(*cols)


@query("pip_05_direct_event_days", "SELECT * FROM direct_days", "direct_days")
def _(spark, d):
    return L.direct_event_days(L.weekly_events(V.weekly(spark, d)))


@query(
    "dat_05_event_day_from_offset",
    "SELECT event_day_source, event_day - weekly_date AS day_offset, count(*) AS days FROM direct_days GROUP BY ALL",
    "direct_days",
)
def _(spark, d):
    days = L.direct_event_days(L.weekly_events(V.weekly(spark, d)))
    offset = (F.col("event_day") - F.col("weekly_date")).alias("day_offset")
    return days.groupBy("event_day_source", offset).agg(F.count(F.lit(1)).alias("days"))


@query("pip_06_daily_scores", "SELECT * FROM daily_scores", "daily_scores")
def _(spark, d):
    return L.daily_scores(V.daily(spark, d))


@query(
    "mth_02_score_sum",
    "SELECT daily_questionnaire_worsening_score AS score, count(*) AS days FROM daily_scores GROUP BY 1",
    "daily_scores",
)
def _(spark, d):
    scores = L.daily_scores(V.daily(spark, d))
    return scores.groupBy(F.col(L.SCORE).alias("score")).agg(F.count(F.lit(1)).alias("days"))


@query("agg_11_probable_days", "SELECT * FROM probable", "probable")
def _(spark, d):
    return probable_days(spark, d)


@query("win_02_episodes", "SELECT * FROM episodes", "episodes")
def _(spark, d):
    return episodes(spark, d)


@query(
    "win_03_episode_numbers",
    """SELECT user_key, threshold, count(*) AS n_episodes, max(episode_id) AS last_id, min(event_onset_day) AS first_onset
       FROM episodes GROUP BY 1, 2""",
    "episodes",
)
def _(spark, d):
    runs = episodes(spark, d)
    return runs.groupBy("user_key", "threshold").agg(
        F.count(F.lit(1)).alias("n_episodes"), F.max("episode_id").alias("last_id"),
        F.min("event_onset_day").alias("first_onset"),
    )


@query(
    "str_05_plus_join",
    "SELECT event_day_sources, count(*) AS episodes, max(len(string_split(event_day_sources, '+'))) AS n_sources FROM episodes GROUP BY 1",
    "episodes",
)
def _(spark, d):
    runs = episodes(spark, d)
    return runs.groupBy("event_day_sources").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.max(F.size(F.split("event_day_sources", r"\+"))).cast("bigint").alias("n_sources"),
    )


SUMMARY = """
SELECT 'weekly_rows' AS metric, CAST(NULL AS INTEGER) AS threshold, count(*) AS value FROM weekly_events
UNION ALL SELECT 'broad_positive_weeks', NULL, count(*) FROM weekly_events WHERE broad_event_week
UNION ALL SELECT 'broad_negative_weeks', NULL, count(*) FROM weekly_events WHERE NOT broad_event_week
UNION ALL SELECT 'positive_week_daily_score_rows', NULL, count(*) FROM week_scores
UNION ALL SELECT 'direct_offset_event_user_days', NULL, count(*) FROM (SELECT DISTINCT user_key, event_day FROM direct_days)
UNION ALL SELECT 'probable_event_user_days', threshold, count(*) FROM probable GROUP BY threshold
UNION ALL SELECT 'event_episodes', threshold, count(*) FROM episodes GROUP BY threshold
UNION ALL SELECT 'episode_users', threshold, count(DISTINCT user_key) FROM episodes GROUP BY threshold
"""


@query("agg_17_label_summary", SUMMARY, "episodes")
def _(spark, d):
    return label_tables(spark, d).summary


@query("pip_07_label_tables", SUMMARY, "episodes")
def _(spark, d):
    tables = label_tables(spark, d)
    folder = scratch_dir(spark)
    L.write_labels(tables, folder)
    return spark.read.schema("metric STRING, threshold INT, value BIGINT").csv(f"{folder}/event_label_summary", header=True)


@query(
    "arr_01_day_sets",
    """SELECT user_key, covered_day, positive FROM covered_days""",
    "covered_days",
)
def _(spark, d):
    days = P.covered_days(L.weekly_events(V.weekly(spark, d)))
    return days.select("user_key", F.col("day").cast("bigint").alias("covered_day"), "positive")


@query(
    "set_05_stable_days",
    "SELECT user_key, CAST(covered_day AS INTEGER) AS sample_anchor_day FROM covered_days WHERE NOT positive",
    "covered_days",
)
def _(spark, d):
    return P.stable_negative_days(L.weekly_events(V.weekly(spark, d)))


@query(
    "set_06_days_in_event_set",
    """SELECT t.threshold, s.user_key, s.date, EXISTS (SELECT 1 FROM probable p WHERE p.threshold = t.threshold AND p.user_key = s.user_key
         AND p.event_day = s.date) AS is_event_day FROM daily_scores s, (SELECT DISTINCT threshold FROM probable) t""",
    "daily_scores probable",
)
def _(spark, d):
    days = probable_days(spark, d)
    marked = days.select("threshold", "user_key", F.col("event_day").alias("date"), F.lit(True).alias("hit")).distinct()
    thresholds = F.explode(F.array(*[F.lit(t).cast(days.schema["threshold"].dataType) for t in T]))
    scores = L.daily_scores(V.daily(spark, d)).select("user_key", "date", thresholds.alias("threshold"))
    return scores.join(marked, ["threshold", "user_key", "date"], "left").select(
        "threshold", "user_key", "date", F.coalesce("hit", F.lit(False)).alias("is_event_day")
    )


def negatives(spark, d):
    t = label_tables(spark, d)
    return P.negative_candidates(t.weekly_events, t.probable_days, t.episodes, T, LENGTHS, WASHOUTS)


def samples(spark, d):
    t = label_tables(spark, d)
    return P.build_samples(t.weekly_events, t.probable_days, t.episodes, T, LENGTHS, WASHOUTS)


@query("jon_10_window_exclusion", "SELECT * FROM neg_candidates", "neg_candidates")
def _(spark, d):
    return negatives(spark, d)


@query(
    "jon_11_episode_overlap",
    """SELECT c.user_key, c.sample_anchor_day, c.threshold, c.input_length_days, count(*) AS episodes_hit
       FROM neg_candidates c JOIN episodes e ON e.user_key = c.user_key AND e.threshold = c.threshold
         AND c.window_start_day <= e.event_end_day AND c.window_end_day >= e.event_onset_day
       WHERE c.washout_days = 0 GROUP BY ALL""",
    "neg_candidates",
)
def _(spark, d):
    t = label_tables(spark, d)
    wins = P.negative_candidates(t.weekly_events, t.probable_days, t.episodes, T, LENGTHS, (0,))
    hit = timejoin.count_overlaps(
        wins, t.episodes, ["user_key", "threshold"], ("window_start_day", "window_end_day"), ("event_onset_day", "event_end_day"), "episodes_hit"
    )
    return hit.select("user_key", "sample_anchor_day", "threshold", "input_length_days", "episodes_hit")


@query("pip_08_sample_index", "SELECT * FROM samples", "samples")
def _(spark, d):
    return samples(spark, d)[0]


COUNTS = """
SELECT threshold, input_length_days, washout_days, positive_candidates, positive_samples,
       positive_excluded_not_enough_history, negative_candidates, negative_samples,
       negative_excluded_positive_week_overlap, negative_excluded_event_overlap, negative_excluded_washout,
       negative_excluded_positive_week_overlap + negative_excluded_event_overlap + negative_excluded_washout AS negative_excluded_total,
       positive_samples + negative_samples AS total_samples
FROM (
  SELECT g.*, (SELECT count(*) FROM pos_candidates p WHERE p.threshold = g.threshold AND p.input_length_days = g.input_length_days
               AND p.washout_days = g.washout_days) AS positive_candidates,
    (SELECT count(*) FROM pos_candidates p WHERE p.threshold = g.threshold AND p.input_length_days = g.input_length_days
               AND p.washout_days = g.washout_days AND enough_history) AS positive_samples,
    (SELECT count(*) FROM pos_candidates p WHERE p.threshold = g.threshold AND p.input_length_days = g.input_length_days
               AND p.washout_days = g.washout_days AND NOT enough_history) AS positive_excluded_not_enough_history,
    n.* EXCLUDE (threshold, input_length_days, washout_days)
  FROM grid g LEFT JOIN (
    SELECT threshold, input_length_days, washout_days, count(*) AS negative_candidates,
           count(*) FILTER (reason IS NULL) AS negative_samples,
           count(*) FILTER (reason = 'positive_week_overlap') AS negative_excluded_positive_week_overlap,
           count(*) FILTER (reason = 'event_overlap') AS negative_excluded_event_overlap,
           count(*) FILTER (reason = 'washout') AS negative_excluded_washout
    FROM neg_candidates GROUP BY ALL) n USING (threshold, input_length_days, washout_days))
"""


@query("agg_18_sample_accounting", COUNTS, "neg_candidates pos_candidates")
def _(spark, d):
    t = label_tables(spark, d)
    neg = P.negative_candidates(t.weekly_events, t.probable_days, t.episodes, T, LENGTHS, WASHOUTS)
    return P.account(P.positive_candidates(t.episodes, LENGTHS, WASHOUTS), neg, T, LENGTHS, WASHOUTS)


@query("pip_10_sample_counts", COUNTS, "neg_candidates pos_candidates")
def _(spark, d):
    return samples(spark, d)[1]


@query(
    "pip_09_contract_check",
    """SELECT rule, 0 AS violations FROM (SELECT unnest(['event_day', 'positive_week_day', 'positive_window_end', 'washout_day']) AS rule)
       UNION ALL SELECT 'samples_checked', CAST(count(*) AS INTEGER) FROM samples""",
    "samples",
)
def _(spark, d):
    t = label_tables(spark, d)
    index = materialize(P.build_samples(t.weekly_events, t.probable_days, t.episodes, T, LENGTHS, WASHOUTS)[0])
    bad = P.contract_violations(index, t.weekly_events, t.probable_days, t.episodes)
    rules = ["event_day", "positive_week_day", "positive_window_end", "washout_day"]
    counted = bad.agg(*[F.count_if(F.col("rule") == r).cast("int").alias(r) for r in rules])
    checked = index.agg(F.count(F.lit(1)).cast("int").alias("samples_checked"))
    return counted.unpivot([], rules, "rule", "violations").unionByName(
        checked.unpivot([], ["samples_checked"], "rule", "violations")
    )


@query(
    "agg_28_user_rates",
    sql_rounded("positive_rate", "SELECT user_key, avg(target_binary) AS positive_rate, count(*) AS n FROM labelled GROUP BY user_key"),
    "labelled",
)
def _(spark, d):
    return rounded(user_rates(labelled(spark, d), "user_key", "target_binary"))


@query(
    "prj_16_alternative_labels",
    """SELECT user_key, anchor_relative_minute,
         CAST(doc_flag OR hospital_flag OR er_flag OR oral_flag OR symptom_flag AS INTEGER) AS label_canonical,
         CAST(doc_flag OR hospital_flag OR er_flag OR oral_flag AS INTEGER) AS label_objective,
         CAST(hospital_flag OR er_flag AS INTEGER) AS label_hospitalisation, CAST(symptom_flag AS INTEGER) AS label_symptom_only
       FROM labelled""",
    "labelled",
)
def _(spark, d):
    from cohortlake.plans.features import alternative_labels

    out = alternative_labels(labelled(spark, d))
    return out.select("user_key", "anchor_relative_minute", *[c for c in out.columns if c.startswith("label_")])


@query(
    "win_04_group_max",
    "SELECT DISTINCT user_key, end_day, max(end_day) OVER (PARTITION BY user_key) AS last_end_day FROM onset_labelled",
    "onset_labelled",
)
def _(spark, d):
    days = onset_labelled(spark, d).select("user_key", "end_day").distinct()
    top = days.groupBy("user_key").agg(F.max("end_day").alias("last_end_day"))
    return days.join(top, "user_key")
