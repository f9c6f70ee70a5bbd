"""Projections, predicates, scalar functions, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.catalogue import labelling  # noqa: F401  (registers labelled windows)
from cohortlake.catalogue.common import minutes, minutes_a, rounded, sql_offsets, sql_rounded
from cohortlake.catalogue.ctes import cte
from cohortlake.catalogue.registry import query
from cohortlake.functions import exprs as E
from cohortlake.operators import daily as D, profile, select, splits
from cohortlake.plans import features as X, labels as L
from cohortlake.sources import schemas as S, standin as V
from cohortlake.sources.schemas import POLLEN_COLUMNS
from cohortlake.sources.tables import require_columns



# --- projections and predicates -------------------------------------------------------------------


@query(
    "prj_01_required_columns",
    "SELECT user_key, date, weekly_doc, weekly_oral FROM weekly",
    "weekly",
)
def _(spark, d):
    cols = ["user_key", "date", "weekly_doc", "weekly_oral"]
    return require_columns(V.weekly(spark, d), cols, "weekly questionnaire").select(*cols)


@query(
    "prj_02_lenient_cast",
    """SELECT weekly_doc, TRY_CAST(weekly_doc AS DOUBLE) AS as_number, count(*) AS n FROM weekly GROUP BY ALL""",
    "weekly",
)
def _(spark, d):
    return V.weekly(spark, d).groupBy("weekly_doc", E.numeric("weekly_doc").alias("as_number")).agg(F.count("*").alias("n"))


@query(
    "prj_03_valid_day",
    "SELECT user_key, date, count(*) AS n FROM inhaler WHERE user_key IS NOT NULL AND date >= 0 GROUP BY ALL",
    "inhaler",
)
def _(spark, d):
    return D.valid_days(V.inhaler(spark, d)).groupBy("user_key", "date").agg(F.count("*").alias("n"))


@query(
    "prj_04_null_out",
    """SELECT user_key, count(*) AS n, count(steps) AS steps_left, count(hr) AS hr_left FROM minutes GROUP BY user_key""",
    "minutes",
)
def _(spark, d):
    return minutes(spark, d).groupBy("user_key").agg(
        F.count("*").alias("n"), F.count("steps").alias("steps_left"), F.count("hr").alias("hr_left")
    )


@query(
    "prj_05_range_filter",
    sql_rounded("pef_max", """SELECT user_key, date, hour, pef_max FROM peakflow
       WHERE date >= 0 AND hour BETWEEN 0 AND 23 AND pef_max > 0"""),
    "peakflow",
)
def _(spark, d):
    pf = V.peakflow(spark, d).filter((F.col("date") >= 0) & F.col("hour").between(0, 23) & (F.col("pef_max") > 0))
    return rounded(pf.select("user_key", "date", "hour", "pef_max"))


@query(
    "prj_06_drop_null_rows",
    "SELECT user_key, date, weekly_er FROM weekly WHERE user_key IS NOT NULL AND date IS NOT NULL AND weekly_er IS NOT NULL",
    "weekly",
)
def _(spark, d):
    return V.weekly(spark, d).dropna(subset=["user_key", "date", "weekly_er"]).select("user_key", "date", "weekly_er")


@query(
    "prj_07_any_flag",
    "SELECT user_key, date, broad_event_week FROM weekly_events",
    "weekly_events",
)
def _(spark, d):
    w = L.weekly_events(V.weekly(spark, d))
    any_ = E.any_flag("doc_flag", "hospital_flag", "er_flag", "oral_flag").alias("broad_event_week")
    return w.select("user_key", "date", any_)


@query("prj_08_k_of_n", "SELECT user_key, date, symptom_flag FROM weekly_targets", "weekly_targets")
def _(spark, d):
    return V.weekly(spark, d).select("user_key", "date", E.at_least_k(E.SYMPTOM_CUTOFFS, 3).alias("symptom_flag"))


@query(
    "prj_09_prefix_names",
    "SELECT trial_id, val_pr_auc AS best_val_pr_auc, val_f1 AS best_val_f1 FROM trials",
    "trials",
)
def _(spark, d):
    t = V.trials(spark, d).select("trial_id", "val_pr_auc", "val_f1")
    return t.withColumnsRenamed({c: f"best_{c}" for c in t.columns if c != "trial_id"})


@query(
    "prj_10_numeric_features",
    """SELECT sample_id, user_key, n_features, test_f1 FROM (SELECT trial_id AS sample_id, seed AS user_key, n_features, test_f1, algo FROM trials)""",
    "trials",
)
def _(spark, d):
    t = V.trials(spark, d).select(
        F.col("trial_id").alias("sample_id"), F.col("seed").alias("user_key"), "n_features", "test_f1", "algo", "threshold"
    )
    return t.select("sample_id", "user_key", *X.feature_columns(t))


@query(
    "prj_11_columns_by_prefix",
    "SELECT trial_id, val_pr_auc, val_roc_auc, val_f1, val_recall, val_recall_at_precision_floor, val_precision_at_recall_floor, val_brier FROM trials",
    "trials",
)
def _(spark, d):
    t = V.trials(spark, d)
    return t.select("trial_id", *X.columns_by_prefix(t, ["val_"]))


@query(
    "prj_12_clip",
    sql_rounded("clipped", "SELECT user_key, date, least(greatest(pef_max, 50), 200) AS clipped FROM peakflow"),
    "peakflow",
)
def _(spark, d):
    return rounded(V.peakflow(spark, d).select("user_key", "date", E.clip("pef_max", 50.0, 200.0).alias("clipped")))


@query(
    "prj_13_membership_filter",
    """SELECT split, count(*) AS n, sum(target) AS positives FROM (
         SELECT v.target, CASE WHEN rn <= greatest(1, ceil(n * 0.2::DOUBLE)) THEN 'test'
           WHEN rn <= greatest(1, ceil(n * 0.2::DOUBLE)) + greatest(1, ceil(n * 0.15::DOUBLE)) THEN 'val' ELSE 'train' END AS split
         FROM vectors v JOIN (
           SELECT user_key, row_number() OVER (ORDER BY md5('42:' || user_key), user_key) AS rn, count(*) OVER () AS n
           FROM (SELECT DISTINCT user_key FROM vectors)) u ON v.user_key = u.user_key)
       GROUP BY split""".replace("sum(target)", "CAST(sum(target) AS BIGINT)"),
    "vectors",
)
def _(spark, d):
    v = V.vectors(spark, d).select("user_key", "target")
    return splits.apply_split(v, splits.three_way_split(v)).groupBy("split").agg(
        F.count("*").alias("n"), F.sum("target").alias("positives")
    )


@query(
    "prj_14_sentinel_fill",
    """SELECT user_key, date, coalesce(CAST(weekly_oral AS DOUBLE), -1) AS weekly_oral,
              coalesce(TRY_CAST(weekly_er AS DOUBLE), -1) AS weekly_er,
              CAST(weekly_oral IS NULL AND TRY_CAST(weekly_er AS DOUBLE) IS NULL AS INTEGER) AS block_missing
       FROM (SELECT user_key, date, CASE WHEN weekly_oral > 1 THEN weekly_oral END AS weekly_oral, weekly_er FROM weekly)""",
    "weekly",
)
def _(spark, d):
    from cohortlake.operators.windows import fill_block

    oral = F.col("weekly_oral")
    w = V.weekly(spark, d).select(
        "user_key", "date", F.when(oral > 1, oral).alias("weekly_oral"), E.numeric("weekly_er").alias("weekly_er")
    )
    return w.select("user_key", "date", *fill_block(["weekly_oral", "weekly_er"], "block_missing"))


@query(
    "prj_15_source_subset",
    sql_rounded("peakflow_pef_mean", """SELECT user_key, date, peakflow_pef_mean, smartinhaler_total_actuations, 'smartinhaler+peakflow' AS tag
       FROM peakflow_daily JOIN smartinhaler_daily USING (user_key, date)"""),
    "peakflow_daily smartinhaler_daily",
)
def _(spark, d):
    asked = ["peakflow", "smartinhaler"]
    tables = {
        "smartinhaler": D.inhaler_daily(V.inhaler(spark, d)),
        "peakflow": D.peakflow_daily(V.peakflow(spark, d), V.patient(spark, d)),
    }
    first, second = (tables[s] for s in X.pick_sources(asked))
    return rounded(first.join(second, ["user_key", "date"]).select(
        "user_key", "date", "peakflow_pef_mean", "smartinhaler_total_actuations", F.lit(X.source_tag(asked)).alias("tag")
    ))


@query(
    "prj_17_baseline_ratio",
    sql_rounded("pef_max pef_baseline peakflow_pef_pct_baseline", "SELECT * FROM peakflow_readings"),
    "peakflow_readings",
)
def _(spark, d):
    return rounded(D.peakflow_readings(V.peakflow(spark, d), V.patient(spark, d)))


@query(
    "prj_18_text_boolean",
    """SELECT user_key, date, coalesce(lower(daily_night_symp) = 'true', false) AS night,
              coalesce(lower(daily_day_symp) = 'true', false) AS daytime, coalesce(daily_limit_activity, false) AS limited FROM daily""",
    "daily",
)
def _(spark, d):
    return V.daily(spark, d).select(
        "user_key", "date", E.text_true("daily_night_symp").alias("night"), E.text_true("daily_day_symp").alias("daytime"),
        E.text_true("daily_limit_activity").alias("limited"),
    )


@query(
    "prj_20_drop_sparse_users",
    """SELECT user_key, count(*) AS n FROM minutes WHERE user_key IN
         (SELECT user_key FROM minutes GROUP BY user_key HAVING avg(CAST(hr IS NULL AS INTEGER)) <= 0.25)
       GROUP BY user_key""",
    "minutes",
)
def _(spark, d):
    m = minutes(spark, d).withColumn("hr_missing", F.col("hr").isNull().cast("int"))
    return X.drop_sparse_users(m, "hr_missing", 0.25).groupBy("user_key").agg(F.count("*").alias("n"))


@query(
    "prj_21_xy_groups",
    f"""SELECT sample_id, {', '.join(f'embedding[{i + 1}] AS x{i}' for i in range(64))}, target AS y, user_key AS grp FROM vectors""",
    "vectors",
)
def _(spark, d):
    return V.vectors(spark, d).select(
        "sample_id", *[F.col("embedding")[i].alias(f"x{i}") for i in range(64)],
        F.col("target").alias("y"), F.col("user_key").alias("grp"),
    )


# --- scalar functions -----------------------------------------------------------------------------


@query(
    "str_01_week_offsets",
    f"""SELECT user_key, date, array_to_string({sql_offsets('weekly_doc')}, '|') AS offsets,
               len({sql_offsets('weekly_doc')}) > 0 AS has_offset FROM weekly""",
    "weekly",
)
def _(spark, d):
    offs = F.transform(E.week_offsets("weekly_doc"), lambda x: x.cast("string"))
    return V.weekly(spark, d).select(
        "user_key", "date", F.array_join(offs, "|").alias("offsets"), E.has_week_offset("weekly_doc").alias("has_offset")
    )


@query(
    "str_02_trigger_overlap",
    "SELECT user_key, date, daily_triggers, trigger_points = 1 AS has_trigger FROM daily_scores",
    "daily_scores",
)
def _(spark, d):
    return V.daily(spark, d).select("user_key", "date", "daily_triggers", E.has_trigger("daily_triggers").alias("has_trigger"))


@query(
    "str_03_pollen_level",
    " UNION ALL ".join(f"""SELECT '{c}' AS pollen, {c} AS name, CAST(CASE lower({c}) WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 WHEN 'high' THEN 3
         WHEN 'very high' THEN 4 END AS INTEGER) AS level, count(*) AS n FROM environment GROUP BY ALL""" for c in POLLEN_COLUMNS),
    "environment",
)
def _(spark, d):
    env = V.environment(spark, d).select(*POLLEN_COLUMNS).unpivot([], POLLEN_COLUMNS, "pollen", "name")
    return env.groupBy("pollen", "name", E.pollen_level("name").alias("level")).agg(F.count("*").alias("n"))


@query(
    "str_04_text_not_zero",
    "SELECT user_key, date, trim(coalesce(weekly_doc, '0')) <> '0' AS doc_flag FROM weekly",
    "weekly",
)
def _(spark, d):
    return V.weekly(spark, d).select("user_key", "date", E.text_not_zero("weekly_doc").alias("doc_flag"))


@query(
    "str_06_param_key",
    """SELECT trial_id, 'max_depth=' || coalesce(CAST(param_max_depth AS VARCHAR), 'None') || ';n_features=' || n_features
         || ';scale_pos_weight=' || param_scale_pos_weight AS params FROM trials""",
    "trials",
)
def _(spark, d):
    params = F.create_map(
        F.lit("scale_pos_weight"), F.col("param_scale_pos_weight"),
        F.lit("max_depth"), F.coalesce(F.col("param_max_depth").cast("string"), F.lit("None")),
        F.lit("n_features"), F.col("n_features").cast("string"),
    )
    return V.trials(spark, d).select("trial_id", E.param_key(params).alias("params"))


@query(
    "str_07_decode_params",
    sql_rounded("scale_pos_weight", """SELECT t.trial_id, t.param_max_depth AS max_depth,
         coalesce(TRY_CAST(param_scale_pos_weight AS DOUBLE), r.class_ratio) AS scale_pos_weight
       FROM trials t JOIN (SELECT algo, count(*) FILTER (val_f1 < 0.7) / CAST(count(*) FILTER (val_f1 >= 0.7) AS DOUBLE) AS class_ratio
                           FROM trials GROUP BY algo) r ON t.algo = r.algo"""),
    "trials",
)
def _(spark, d):
    t = V.trials(spark, d)
    good = F.col("val_f1") >= 0.7
    ratio = t.groupBy("algo").agg(E.ratio(F.count_if(~good), F.count_if(good)).alias("class_ratio"))
    return rounded(t.join(ratio, "algo").select(
        "trial_id", F.col("param_max_depth").try_cast("int").alias("max_depth"),
        F.coalesce(E.numeric("param_scale_pos_weight"), "class_ratio").alias("scale_pos_weight"),
    ))


@query(
    "str_08_report_numbers",
    """SELECT trial_id, coalesce(printf('%.3f', val_pr_auc), '---') AS val_text, coalesce(printf('%d', n_features), '---') AS n_text,
              printf('%.3f', train_pr_auc) || ' +/- ' || printf('%.3f', coalesce(test_pr_auc, 0)) AS both_text FROM trials""",
    "trials",
)
def _(spark, d):
    return V.trials(spark, d).select(
        "trial_id", E.report_number("val_pr_auc").alias("val_text"), E.report_int("n_features").alias("n_text"),
        E.mean_pm_std("train_pr_auc", "test_pr_auc").alias("both_text"),
    )


@query(
    "dat_01_relative_minute",
    """SELECT user_key, date, time, minutes_from_midnight, relative_minute, count(*) AS n FROM minutes GROUP BY ALL""",
    "minutes",
)
def _(spark, d):
    cols = ["user_key", "date", "time", "minutes_from_midnight", "relative_minute"]
    return minutes(spark, d).groupBy(*cols).agg(F.count("*").alias("n"))


@query(
    "dat_02_window_end_day",
    """SELECT user_key, anchor_relative_minute, CAST(floor(anchor_relative_minute / 1440.0) - 1 AS INTEGER) AS end_day,
              CAST(floor((anchor_relative_minute - 1440) / 1440.0) AS INTEGER) AS first_day FROM anchors""",
    "anchors",
)
def _(spark, d):
    return labelling.anchors(spark, d).select(
        "user_key", "anchor_relative_minute", E.window_end_day("anchor_relative_minute").alias("end_day"),
        E.window_first_day("anchor_relative_minute").alias("first_day"),
    )


@query(
    "dat_03_day_part",
    "SELECT user_key, is_day, count(*) AS n FROM minutes_a GROUP BY ALL",
    "minutes_a",
)
def _(spark, d):
    m = minutes(spark, d).withColumn("is_day", E.is_daytime("minutes_from_midnight").cast("int"))
    return m.groupBy("user_key", "is_day").agg(F.count("*").alias("n"))


@query(
    "dat_04_covered_week",
    """SELECT user_key, date, week_start_day, week_end_day, date + 1 AS questionnaire_day,
              CAST((date + 1) * 1440 AS BIGINT) AS questionnaire_relative_minute FROM weekly_events""",
    "weekly_events",
)
def _(spark, d):
    day = F.col("date") + 1
    return L.weekly_events(V.weekly(spark, d)).select(
        "user_key", "date", "week_start_day", "week_end_day", day.alias("questionnaire_day"),
        (day * E.DAY_MINUTES).cast("bigint").alias("questionnaire_relative_minute"),
    )


@query(
    "map_01_activity_group",
    "SELECT activity_type, activity_group, is_active_minute, count(*) AS n FROM minutes_a GROUP BY ALL",
    "minutes_a",
)
def _(spark, d):
    return minutes_a(spark, d).groupBy("activity_type", "activity_group", "is_active_minute").agg(F.count("*").alias("n"))


@query(
    "map_02_relief_points",
    "SELECT daily_relief_inhaler, relief_inhaler_points, count(*) AS n FROM daily_scores GROUP BY ALL",
    "daily_scores",
)
def _(spark, d):
    points = E.relief_points("daily_relief_inhaler").alias("relief_inhaler_points")
    return V.daily(spark, d).groupBy("daily_relief_inhaler", points).agg(F.count("*").alias("n"))


@query(
    "mth_01_slope",
    sql_rounded("hr_slope", """SELECT user_key, CASE WHEN count(hr) >= 2 AND min(relative_minute) FILTER (hr IS NOT NULL)
         < max(relative_minute) FILTER (hr IS NOT NULL) THEN regr_slope(hr, relative_minute) END AS hr_slope FROM minutes GROUP BY user_key"""),
    "minutes",
)
def _(spark, d):
    m = minutes(spark, d)
    return rounded(m.groupBy("user_key").agg(F.regr_slope("hr", "relative_minute").alias("hr_slope")))


@query(
    "mth_03_differences",
    sql_rounded("gap ratio", """SELECT trial_id, train_pr_auc - val_pr_auc AS gap,
         CASE WHEN train_pr_auc <> 0 THEN val_pr_auc / train_pr_auc END AS ratio, round(val_pr_auc, 1) + 0 AS coarse FROM trials"""),
    "trials",
)
def _(spark, d):
    return rounded(V.trials(spark, d).select(
        "trial_id", (F.col("train_pr_auc") - F.col("val_pr_auc")).alias("gap"),
        E.ratio("val_pr_auc", "train_pr_auc").alias("ratio"), F.round("val_pr_auc", 1).alias("coarse"),
    ))


@query(
    "mth_04_finite_or_zero",
    sql_rounded("cleaned", """SELECT trial_id, CASE WHEN train_pr_auc = 0 THEN 0 ELSE coalesce(val_pr_auc / train_pr_auc, 0) END AS cleaned FROM trials"""),
    "trials",
)
def _(spark, d):
    # A zero denominator gives infinity here, as in floating-point arithmetic, and must end as 0.
    den = F.col("train_pr_auc")
    raw = F.when(den == 0, F.lit(float("inf"))).otherwise(F.try_divide("val_pr_auc", "train_pr_auc"))
    return rounded(V.trials(spark, d).select("trial_id", E.finite_or_zero(raw).alias("cleaned")))


@query(
    "jsn_01_struct_json",
    """SELECT user_key, date, 5 + date % 2 AS seed_back, 0.15::DOUBLE AS val_frac_back FROM weekly""",
    "weekly",
)
def _(spark, d):
    doc = F.to_json(F.struct((5 + F.col("date") % 2).alias("seed"), F.lit(0.15).alias("val_frac")))
    back = F.from_json(doc, "seed INT, val_frac DOUBLE")
    return V.weekly(spark, d).select(
        "user_key", "date", back["seed"].alias("seed_back"), back["val_frac"].alias("val_frac_back")
    )


# --- sorts and top-k ------------------------------------------------------------------------------


@query(
    "srt_01_multi_key_sort",
    "SELECT user_key, event_onset_day, event_end_day, threshold FROM episodes ORDER BY user_key, event_onset_day, threshold",
    "episodes",
)
def _(spark, d):
    from cohortlake.catalogue.common import episodes

    runs = episodes(spark, d).select("user_key", "event_onset_day", "event_end_day", "threshold")
    return runs.orderBy("user_key", "event_onset_day", "threshold")


@query(
    "srt_02_metric_sort",
    "SELECT trial_id, val_pr_auc, val_brier FROM trials ORDER BY val_pr_auc DESC NULLS LAST, val_brier, trial_id",
    "trials",
)
def _(spark, d):
    t = V.trials(spark, d).select("trial_id", "val_pr_auc", "val_brier")
    return t.orderBy(F.desc_nulls_last("val_pr_auc"), F.asc_nulls_last("val_brier"), "trial_id")


@query(
    "srt_03_overall_winner",
    """SELECT trial_id, val_pr_auc FROM trials
       ORDER BY val_pr_auc DESC NULLS LAST, val_recall_at_precision_floor DESC NULLS LAST,
         round(train_pr_auc - val_pr_auc, 9) NULLS LAST, val_brier, n_features, val_roc_auc DESC, val_f1 DESC, trial_id LIMIT 1""",
    "trials",
)
def _(spark, d):
    t = V.trials(spark, d).withColumn("train_val_pr_auc_gap", F.round(F.col("train_pr_auc") - F.col("val_pr_auc"), 9))
    return select.overall_best(t).select("trial_id", "val_pr_auc")


@query(
    "srt_04_latest_row",
    "SELECT user_key, max(date) AS date, arg_max(weekly_wheeze, date) AS weekly_wheeze FROM weekly GROUP BY user_key",
    "weekly",
)
def _(spark, d):
    return V.weekly(spark, d).groupBy("user_key").agg(
        F.max("date").alias("date"), F.max_by("weekly_wheeze", "date").alias("weekly_wheeze")
    )


# --- set operations -------------------------------------------------------------------------------


@query(
    "set_01_union_all",
    """SELECT user_key, count(*) AS n FROM (SELECT user_key, date, hour FROM inhaler UNION ALL SELECT user_key, date, hour FROM peakflow)
       GROUP BY user_key""",
    "inhaler peakflow",
)
def _(spark, d):
    cols = ["user_key", "date", "hour"]
    both = V.inhaler(spark, d).select(*cols).unionByName(V.peakflow(spark, d).select(*cols))
    return both.groupBy("user_key").agg(F.count("*").alias("n"))


@query(
    "set_02_union_by_name",
    """SELECT user_key, count(*) AS n, count(name) AS named, count(morning) AS with_morning FROM
         (SELECT * FROM inhaler UNION ALL BY NAME SELECT * FROM peakflow) GROUP BY user_key""",
    "inhaler peakflow",
)
def _(spark, d):
    both = profile.union_present([V.inhaler(spark, d), None, V.peakflow(spark, d)])
    return both.groupBy("user_key").agg(
        F.count("*").alias("n"), F.count("name").alias("named"), F.count("morning").alias("with_morning")
    )


@query("set_03_distinct_rows", "SELECT DISTINCT user_key, date, hour, name FROM inhaler", "inhaler")
def _(spark, d):
    return V.inhaler(spark, d).dropDuplicates()


@query(
    "set_04_keep_first",
    """SELECT user_key, date, name, hour FROM (SELECT *, row_number() OVER (PARTITION BY user_key, date
         ORDER BY hour, name NULLS FIRST) AS rn FROM inhaler) WHERE rn = 1""",
    "inhaler",
)
def _(spark, d):
    first = F.min(F.struct("hour", "name")).alias("r")
    return V.inhaler(spark, d).groupBy("user_key", "date").agg(first).select("user_key", "date", "r.name", "r.hour")


@query(
    "set_07_lost_users",
    "SELECT c_custkey AS user_key FROM customer WHERE c_custkey NOT IN (SELECT user_key FROM minutes WHERE hr > 150)",
    "minutes",
)
def _(spark, d):
    seen = minutes(spark, d).filter("hr > 150").select("user_key")
    return V.patient(spark, d).select("user_key").join(seen, "user_key", "left_anti")


@query(
    "set_08_split_overlap",
    "SELECT 0 AS shared, CAST(count(DISTINCT user_key) AS INTEGER) AS users FROM minutes",
    "minutes",
)
def _(spark, d):
    split = splits.three_way_split(minutes(spark, d))
    parts = {n: split.filter(F.col("split") == n) for n in ("train", "val", "test")}
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    shared = None
    for a, b in pairs:
        both = splits.overlap(parts[a], parts[b])
        shared = both if shared is None else shared.unionByName(both)
    users = split.agg(F.count("*").cast("int")).scalar()
    return shared.agg(F.count("*").cast("int").alias("shared")).withColumn("users", users)
