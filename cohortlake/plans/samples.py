"""Positive and stable negative samples over a whole (threshold, length, washout) grid in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.operators.timejoin import lay_out_days, nearest_row
from cohortlake.sources import schemas as S
from cohortlake.sources.tables import GRID_KEYS

USER = "user_key"
REASONS = ["positive_week_overlap", "event_overlap", "washout"]


def covered_days(events: DataFrame) -> DataFrame:
    """One row per (user, day) covered by a questionnaire, with whether any covering week was positive."""
    return (
        lay_out_days(events.filter("has_valid_covered_days"), "week_start_day", "week_end_day")
        .groupBy(USER, "day")
        .agg(F.bool_or("broad_event_week").alias("positive"))
    )


def stable_negative_days(events: DataFrame) -> DataFrame:
    """Days covered by negative weeks only."""
    return covered_days(events).filter(~F.col("positive")).select(USER, F.col("day").alias("sample_anchor_day"))


def positive_week_days(events: DataFrame) -> DataFrame:
    return covered_days(events).filter("positive").select(USER, "day")


def washout_days(runs: DataFrame, washouts: Sequence[int]) -> DataFrame:
    """Days after each episode's end, per (threshold, washout)."""
    steps = F.array(*[F.lit(w) for w in washouts if w > 0])
    spans = runs.select(USER, "threshold", "event_end_day", F.explode(steps).alias("washout_days"))
    first, last = F.col("event_end_day") + 1, F.col("event_end_day") + F.col("washout_days")
    return spans.select(USER, "threshold", "washout_days", F.explode(F.sequence(first, last)).alias("day")).distinct()


def _grid(lengths: Sequence[int], washouts: Sequence[int]) -> Column:
    cells = [
        F.struct(F.lit(n).alias("input_length_days"), F.lit(w).alias("washout_days")) for n in lengths for w in washouts
    ]
    return F.explode(F.array(*cells)).alias("cell")


def negative_candidates(
    events: DataFrame,
    probable: DataFrame,
    runs: DataFrame,
    thresholds: Sequence[int],
    lengths: Sequence[int],
    washouts: Sequence[int],
) -> DataFrame:
    """Every stable day in every grid cell, with the first rule that excludes it (or NULL).

    A window [a-L, a] holds a day of some set exactly when the set's last day up to ``a`` is not before
    a-L. That last day does not depend on L or W, so it is looked up once per (user, threshold, day) and the
    grid is laid out afterwards with plain comparisons: no window is ever exploded into its days.
    """
    anchor = F.col("sample_anchor_day")
    marks = positive_week_days(events).withColumnRenamed("day", "last_positive")
    base = nearest_row(
        stable_negative_days(events), marks, [USER], "sample_anchor_day", "last_positive", ["last_positive"],
        forward=False, strict=False,
    ).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    none = F.lit(None).cast("int")
    onset, end = F.col("event_onset_day"), F.col("event_end_day")
    known = (
        probable.select(USER, "threshold", F.col("event_day").alias("seen"), F.col("event_day").alias("last_event"),
                        none.alias("last_episode_end"), none.alias("last_closed_end"))
        .unionByName(runs.select(USER, "threshold", (onset + 1).alias("seen"), none.alias("last_event"),
                                 end.alias("last_episode_end"), none.alias("last_closed_end")))
        .unionByName(runs.select(USER, "threshold", (end + 1).alias("seen"), none.alias("last_event"),
                                 none.alias("last_episode_end"), end.alias("last_closed_end")))
    )
    placed = nearest_row(
        base, known, [USER, "threshold"], "sample_anchor_day", "seen",
        ["last_event", "last_episode_end", "last_closed_end"], forward=False, strict=False, per_column=True,
    )
    laid = placed.select("*", _grid(lengths, washouts)).select("*", "cell.*").drop("cell")
    start = anchor - F.col("input_length_days")
    reason = (
        F.when(F.col("last_positive") >= start, REASONS[0])
        .when((F.col("last_event") >= start) | (F.col("last_episode_end") >= start), REASONS[1])
        .when((F.col("washout_days") > 0) & (F.col("last_closed_end") + F.col("washout_days") >= start), REASONS[2])
    )
    return laid.filter(start >= 0).select(
        USER, "sample_anchor_day", start.alias("window_start_day"), (anchor - 1).alias("window_end_day"),
        *GRID_KEYS, reason.alias("reason"),
    )


def positive_candidates(runs: DataFrame, lengths: Sequence[int], washouts: Sequence[int]) -> DataFrame:
    """Every episode onset in every grid cell; ``enough_history`` is false when the window starts before day 0."""
    laid = runs.select("*", _grid(lengths, washouts)).select("*", "cell.*").drop("cell")
    onset = F.col("event_onset_day")
    start = onset - F.col("input_length_days")
    return laid.select(
        USER, onset.alias("sample_anchor_day"), start.alias("window_start_day"), (onset - 1).alias("window_end_day"),
        "event_onset_day", "event_end_day", *GRID_KEYS, (start >= 0).alias("enough_history"),
    )


SAMPLE_COLUMNS = [
    USER, "sample_anchor_day", "window_start_day", "window_end_day", "event_onset_day", "event_end_day", "target",
    "sample_type", "label_strategy", *GRID_KEYS,
]


def build_samples(
    events: DataFrame,
    probable: DataFrame,
    runs: DataFrame,
    thresholds: Sequence[int] = (2, 3, 4),
    lengths: Sequence[int] = (7, 14, 28),
    washouts: Sequence[int] = (0, 7, 14),
) -> tuple[DataFrame, DataFrame]:
    """Sample index and its accounting, for all grid cells at once."""
    pos = positive_candidates(runs, lengths, washouts)
    neg = negative_candidates(events, probable, runs, thresholds, lengths, washouts)
    none = F.lit(None).cast("int")

    def finish(df: DataFrame, target: int, kind: str) -> DataFrame:
        return df.withColumns(
            {"target": F.lit(target), "sample_type": F.lit(kind), "label_strategy": F.lit(S.LABEL_STRATEGY)}
        ).select(*SAMPLE_COLUMNS)

    samples = finish(pos.filter("enough_history"), 1, "positive_onset").unionByName(
        finish(
            neg.filter(F.col("reason").isNull()).withColumns({"event_onset_day": none, "event_end_day": none}),
            0, "stable_negative",
        )
    )
    return samples, account(pos, neg, thresholds, lengths, washouts)


def account(
    pos: DataFrame, neg: DataFrame, thresholds: Sequence[int], lengths: Sequence[int], washouts: Sequence[int]
) -> DataFrame:
    """Counts of candidates, kept samples and exclusions by reason, one row per grid cell (also empty ones)."""
    spark = pos.sparkSession
    cells = [(t, n, w) for t in thresholds for n in lengths for w in washouts]
    spine = spark.createDataFrame(cells, "threshold INT, input_length_days INT, washout_days INT")
    p = pos.groupBy(*GRID_KEYS).agg(
        F.count(F.lit(1)).alias("positive_candidates"),
        F.count_if("enough_history").alias("positive_samples"),
        F.count_if(~F.col("enough_history")).alias("positive_excluded_not_enough_history"),
    )
    n = neg.groupBy(*GRID_KEYS).agg(
        F.count(F.lit(1)).alias("negative_candidates"),
        F.count_if(F.col("reason").isNull()).alias("negative_samples"),
        *[F.count_if(F.col("reason") == r).alias(f"negative_excluded_{r}") for r in REASONS],
        F.count("reason").alias("negative_excluded_total"),
    )
    out = spine.join(p, GRID_KEYS, "left").join(n, GRID_KEYS, "left").fillna(0)
    return out.withColumn("total_samples", F.col("positive_samples") + F.col("negative_samples"))


def contract_violations(samples: DataFrame, events: DataFrame, probable: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows that break the sampling contract, with the broken rule.

    Positives must end the day before the onset. Negatives must hold no event day, positive-week day or
    washout day from the window start through the anchor. They hold one exactly when the last such day up to the anchor
    is not before the start, so no window is exploded into its days.
    """
    pos = samples.filter("target = 1").filter(F.col("window_end_day") != F.col("event_onset_day") - 1)
    neg = samples.filter("target = 0")
    washed = runs.select(USER, "threshold", "event_end_day").join(
        samples.select("threshold", "washout_days").distinct().filter("washout_days > 0"), "threshold"
    )
    first, last = F.col("event_end_day") + 1, F.col("event_end_day") + F.col("washout_days")
    washed = washed.select(USER, "threshold", "washout_days", F.explode(F.sequence(first, last)).alias("day"))
    events_on = probable.select(USER, "threshold", F.col("event_day").alias("day"))
    checks = [
        (events_on, [USER, "threshold"], "event_day"),
        (positive_week_days(events), [USER], "positive_week_day"),
        (washed, [USER, "threshold", "washout_days"], "washout_day"),
    ]
    out = pos.withColumn("rule", F.lit("positive_window_end"))
    for days, keys, rule in checks:
        last = nearest_row(neg, days, keys, "sample_anchor_day", "day", ["day"], forward=False, strict=False)
        hit = last.filter(F.col("day") >= F.col("window_start_day")).drop("day").distinct()
        out = out.unionByName(hit.withColumn("rule", F.lit(rule)))
    return out


def verify_samples(samples: DataFrame, events: DataFrame, probable: DataFrame, runs: DataFrame) -> None:
    bad = contract_violations(samples, events, probable, runs).limit(5).collect()
    if bad:
        raise AssertionError(f"sample contract broken, for example {[r.asDict() for r in bad]}")
