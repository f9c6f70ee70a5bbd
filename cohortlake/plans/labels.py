"""From questionnaires to labels: weekly targets, event weeks, probable days, episodes, window labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortlake.functions import exprs as E
from cohortlake.operators.timejoin import nearest_row, rows_in_intervals
from cohortlake.sources import schemas as S
from cohortlake.sources.tables import materialize, require_columns, write_report_csv

USER, DATE = "user_key", "date"
V1_FLAGS = ["doc_flag", "hospital_flag", "er_flag", "oral_flag", "symptom_flag"]
QUESTIONNAIRE_FIELDS = ["questionnaire_relative_minute", "target_binary", "week_end_day", "questionnaire_day", *V1_FLAGS]


def weekly_targets(weekly: DataFrame, oral_from: int = 3) -> DataFrame:
    """First-generation weekly target: any of doctor, hospital, ER, oral steroid or three symptom domains.

    Hospital and ER are compared with 0 as numbers, as in the study, so negative offsets do not count here.
    """
    cols = [USER, DATE, *S.SYMPTOM_COLUMNS, *S.DIRECT_EVENT_FIELDS, "weekly_oral"]
    require_columns(weekly, cols, "weekly questionnaire")
    w = weekly.select(*cols).dropna(subset=[USER, DATE]).dropDuplicates()
    as_numbers = [*S.SYMPTOM_COLUMNS, "weekly_hospital", "weekly_er", "weekly_oral"]
    w = w.withColumns(
        {**{c: E.numeric(c) for c in as_numbers}, "weekly_doc": F.trim(F.coalesce("weekly_doc", F.lit("0")))}
    )

    def over(c: str, bound: int, strict: bool) -> Column:
        x = F.coalesce(c, F.lit(0.0))
        return x > bound if strict else x >= bound

    w = w.withColumns(
        {
            "doc_flag": E.text_not_zero("weekly_doc"),
            "hospital_flag": over("weekly_hospital", 0, True),
            "er_flag": over("weekly_er", 0, True),
            "oral_flag": over("weekly_oral", oral_from, False),
            "symptom_flag": E.at_least_k(E.SYMPTOM_CUTOFFS, 3),
        }
    )
    day = F.col(DATE).cast("int")
    return w.withColumns(
        {
            "target_binary": E.any_flag(*V1_FLAGS).cast("int"),
            "week_end_day": day,
            "questionnaire_day": day + 1,
            "questionnaire_relative_minute": ((day + 1) * E.DAY_MINUTES).cast("bigint"),
        }
    )


def label_windows(windows: DataFrame, targets: DataFrame, max_horizon_days: int = 7) -> DataFrame:
    """Give each window the target of the next questionnaire, strictly later and within the horizon."""
    joined = nearest_row(
        windows, targets, [USER], "anchor_relative_minute", "questionnaire_relative_minute", QUESTIONNAIRE_FIELDS,
        forward=True, bucket=7 * E.DAY_MINUTES,
    )
    gap = F.col("questionnaire_relative_minute") - F.col("anchor_relative_minute")
    return joined.withColumns(
        {"time_to_label_minutes": gap, "time_to_label_days": gap / E.DAY_MINUTES}
    ).filter(F.col("time_to_label_minutes").between(0, max_horizon_days * E.DAY_MINUTES))


def label_summary(labeled: DataFrame, target: str = "target_binary") -> DataFrame:
    counts = labeled.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("pct", F.col("count") / total * 100)


def weekly_events(weekly: DataFrame, oral_equals: int = 3) -> DataFrame:
    """Broad event weeks with the days each questionnaire covers."""
    cols = [USER, DATE, *S.DIRECT_EVENT_FIELDS, "weekly_oral"]
    require_columns(weekly, cols, "weekly questionnaire")
    flags = {f"{c.removeprefix('weekly_')}_flag": E.has_week_offset(c) for c in S.DIRECT_EVENT_FIELDS}
    flags["oral_flag"] = F.coalesce(E.numeric("weekly_oral") == oral_equals, F.lit(False))
    day = F.col(DATE).cast("int")
    return (
        weekly.select(*cols)
        .dropna(subset=[USER, DATE])
        .dropDuplicates()
        .withColumns({DATE: day, **flags})
        .withColumns(
            {
                "broad_event_week": E.any_flag(*flags),
                "week_start_day": F.greatest(day - 7, F.lit(0)),
                "week_end_day": day - 1,
                "label_strategy": F.lit(S.LABEL_STRATEGY),
            }
        )
        .withColumn("has_valid_covered_days", F.col("week_end_day") >= F.col("week_start_day"))
    )


def _positive(events: DataFrame) -> DataFrame:
    return events.filter(F.col("broad_event_week") & F.col("has_valid_covered_days"))


def direct_event_days(events: DataFrame) -> DataFrame:
    """Days that an event field names by its offset."""
    fields = F.array(
        *[F.struct(F.lit(c).alias("source"), E.week_offsets(c).alias("offsets")) for c in S.DIRECT_EVENT_FIELDS]
    )
    return (
        _positive(events)
        .select(USER, F.col(DATE).alias("weekly_date"), F.explode(fields).alias("f"))
        .select(USER, "weekly_date", F.col("f.source").alias("event_day_source"), F.explode("f.offsets").alias("offset"))
        .select(
            USER,
            (F.col("weekly_date") + F.col("offset")).alias("event_day"),
            "weekly_date",
            "event_day_source",
            F.lit("high").alias("event_day_confidence"),
        )
        .filter(F.col("event_day") >= 0)
        .distinct()
    )


POINTS = [
    "relief_inhaler_points", "night_symptom_points", "day_symptom_points", "activity_limit_points",
    "preventer_more_than_usual_points", "trigger_points",
]
SCORE = "daily_questionnaire_worsening_score"


def daily_scores(daily: DataFrame) -> DataFrame:
    """Worsening score of each daily questionnaire: the sum of six components."""
    cols = [
        USER, DATE, "daily_night_symp", "daily_day_symp", "daily_limit_activity", "daily_prev_inhaler",
        "daily_relief_inhaler", "daily_triggers",
    ]
    require_columns(daily, cols, "daily questionnaire")
    points = [
        E.relief_points("daily_relief_inhaler"),
        E.text_true("daily_night_symp").cast("int"),
        E.text_true("daily_day_symp").cast("int"),
        E.text_true("daily_limit_activity").cast("int"),
        F.coalesce(E.numeric("daily_prev_inhaler") == 4, F.lit(False)).cast("int"),
        E.has_trigger("daily_triggers").cast("int"),
    ]
    return (
        daily.select(*cols)
        .dropna(subset=[USER, DATE])
        .dropDuplicates()
        .withColumns(dict(zip(POINTS, points)))
        .withColumn(SCORE, reduce(lambda a, b: a + b, [F.col(p) for p in POINTS]))
    )


def scores_in_positive_weeks(scores: DataFrame, events: DataFrame) -> DataFrame:
    """Daily rows inside positive weeks, one per (user, day, week).

    Where a (user, day, week) has several daily rows, the smallest row by all columns is kept: a total
    order in place of input order.
    """
    weeks = _positive(events).select(USER, F.col(DATE).alias("weekly_date"), "week_start_day", "week_end_day")
    hits = rows_in_intervals(scores, weeks, [USER], DATE, "week_start_day", "week_end_day")
    keys = [USER, DATE, "weekly_date"]
    rest = [c for c in hits.columns if c not in keys]
    return hits.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*")


def probable_event_days(
    events: DataFrame, week_scores: DataFrame, thresholds: Sequence[int] = (2, 3, 4)
) -> DataFrame:
    """Evidence per (threshold, user, day): named days at every threshold, scored days from the threshold up."""
    steps = F.array(*[F.lit(t) for t in thresholds])
    empty = F.lit(None).cast("int")
    direct = direct_event_days(events).select(
        USER, "event_day", "weekly_date", "event_day_source", empty.alias("score"), F.explode(steps).alias("threshold")
    )
    scored = week_scores.select(
        USER, F.col(DATE).alias("event_day"), "weekly_date", F.lit("daily_score").alias("event_day_source"),
        F.col(SCORE).alias("score"), F.explode(F.filter(steps, lambda t: t <= F.col(SCORE))).alias("threshold"),
    )
    high = F.bool_or(F.col("event_day_source").isin(S.DIRECT_EVENT_FIELDS))
    weeks = F.transform(F.array_sort(F.collect_set("weekly_date")), lambda x: x.cast("string"))
    return (
        direct.unionByName(scored)
        .groupBy(USER, "event_day", "threshold")
        .agg(
            F.lit(1).alias("probable_event_day"),
            E.plus_join(F.collect_set("event_day_source")).alias("event_day_source"),
            F.when(high, "high").otherwise("probable").alias("event_day_confidence"),
            F.max("score").cast("double").alias(SCORE),
            F.array_join(weeks, ",").alias("weekly_dates"),
        )
    )


def day_islands(days: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Add ``island``: the same number for days that follow each other without a gap.

    Expects one row per (keys, day), so a key holds at most its study days.
    """
    order = W.partitionBy(*keys).orderBy(day)
    return days.withColumn("island", F.col(day) - F.row_number().over(order))


def episodes(probable: DataFrame) -> DataFrame:
    """Runs of consecutive probable days per (threshold, user)."""
    keys = [USER, "threshold"]
    runs = (
        day_islands(probable, keys, "event_day")
        .groupBy(*keys, "island")
        .agg(
            F.min("event_day").alias("event_onset_day"),
            F.max("event_day").alias("event_end_day"),
            F.count(F.lit(1)).alias("event_day_count"),
            F.bool_or(F.col("event_day_confidence") == "high").alias("has_high_confidence_day"),
            E.plus_join(F.flatten(F.collect_set(F.split("event_day_source", r"\+")))).alias("event_day_sources"),
        )
    )
    number = F.row_number().over(W.partitionBy(*keys).orderBy("event_onset_day"))
    return runs.select(
        *keys, number.alias("episode_id"), "event_onset_day", "event_end_day",
        (F.col("event_end_day") - F.col("event_onset_day") + 1).alias("event_duration_days"),
        "event_day_count", "has_high_confidence_day", "event_day_sources",
    )


def summarize(events: DataFrame, week_scores: DataFrame, probable: DataFrame, runs: DataFrame) -> DataFrame:
    """Long label summary: (metric, threshold, value)."""

    def flat(df: DataFrame, **metrics: Column) -> DataFrame:
        one = df.agg(*[c.cast("bigint").alias(n) for n, c in metrics.items()])
        return one.unpivot([], list(metrics), "metric", "value").withColumn("threshold", F.lit(None).cast("int"))

    def per_threshold(df: DataFrame, **metrics: Column) -> DataFrame:
        grouped = df.groupBy("threshold").agg(*[c.cast("bigint").alias(n) for n, c in metrics.items()])
        return grouped.unpivot(["threshold"], list(metrics), "metric", "value")

    positive = F.col("broad_event_week")
    parts = [
        flat(events, weekly_rows=F.count(F.lit(1)), broad_positive_weeks=F.count_if(positive),
             broad_negative_weeks=F.count_if(~positive)),
        flat(week_scores, positive_week_daily_score_rows=F.count(F.lit(1))),
        flat(direct_event_days(events).select(USER, "event_day").distinct(),
             direct_offset_event_user_days=F.count(F.lit(1))),
        per_threshold(probable, probable_event_user_days=F.count(F.lit(1))),
        per_threshold(runs, event_episodes=F.count(F.lit(1)), episode_users=F.countDistinct(USER)),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).select("metric", "threshold", "value")


@dataclass(frozen=True)
class LabelTables:
    weekly_events: DataFrame
    daily_scores: DataFrame
    probable_days: DataFrame
    episodes: DataFrame
    summary: DataFrame


def build_labels(weekly: DataFrame, daily: DataFrame, thresholds: Sequence[int] = (2, 3, 4)) -> LabelTables:
    """All label tables; the threshold is a column, not a loop.

    Event weeks and probable days each have several readers downstream, so they are written once.
    """
    events = materialize(weekly_events(weekly))
    scores = scores_in_positive_weeks(daily_scores(daily), events)
    probable = materialize(probable_event_days(events, scores, thresholds))
    runs = episodes(probable)
    return LabelTables(events, scores, probable, runs, summarize(events, scores, probable, runs))


def write_labels(labels: LabelTables, folder: str) -> None:
    write_report_csv(labels.weekly_events, f"{folder}/weekly_event_labels")
    write_report_csv(labels.daily_scores, f"{folder}/daily_questionnaire_worsening_scores")
    write_report_csv(labels.summary, f"{folder}/event_label_summary")
    for name, table in (("probable_event_days", labels.probable_days), ("event_episodes", labels.episodes)):
        laid = table.hint("rebalance", "threshold")
        laid.write.mode("overwrite").partitionBy("threshold").csv(f"{folder}/{name}", header=True)


def label_windows_by_onset(windows: DataFrame, probable: DataFrame, horizon_days: int = 7, threshold: int = 3) -> DataFrame:
    """Onset label: the next probable event day after the window's last day, within the horizon.

    Windows whose horizon passes the user's last known day are dropped. The gap to the next event day stays
    filled beyond the horizon. Without any event day nothing is dropped and every target is 0.
    """
    days = materialize(probable.select(USER, "event_day").distinct())
    base = windows.withColumn("end_day", E.window_end_day("anchor_relative_minute"))
    hit = nearest_row(
        base, days.withColumnRenamed("event_day", "next_event_day"), [USER], "end_day", "next_event_day",
        ["next_event_day"], forward=True,
    )
    last_end = base.groupBy(USER).agg(F.max("end_day").alias("_last_end"))
    last_event = days.groupBy(USER).agg(F.max("event_day").alias("_last_event"))
    known = last_end.join(last_event, USER, "left").select(
        USER, F.greatest("_last_end", "_last_event").alias("_known_until")
    )
    no_events = F.lit(days.isEmpty())
    gap = F.col("next_event_day") - F.col("end_day")
    return (
        hit.join(known, USER)
        .filter(no_events | (F.col("end_day") + horizon_days <= F.col("_known_until")))
        .withColumns(
            {
                "time_to_event_days": gap,
                "target_binary": F.coalesce(gap.between(1, horizon_days), F.lit(False)).cast("int"),
                "horizon_days": F.lit(horizon_days),
                "label_strategy": F.lit(f"event_onset_h{horizon_days}_t{threshold}"),
            }
        )
        .drop("_known_until")
    )


ALTERNATIVE_LABELS = {
    "canonical": V1_FLAGS,
    "objective": ["doc_flag", "hospital_flag", "er_flag", "oral_flag"],
    "hospitalisation": ["hospital_flag", "er_flag"],
    "symptom_only": ["symptom_flag"],
}
