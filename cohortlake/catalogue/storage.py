"""Scans and sinks: the stand-in views are written in the study's file formats and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.catalogue.common import minutes, rounded, sql_rounded
from cohortlake.catalogue.registry import query
from cohortlake.operators import daily as D
from cohortlake.operators.profile import union_present
from cohortlake.plans import labels as L
from cohortlake.sources import schemas as S, standin as V, tables as T


@query(
    "src_01_multi_file_csv",
    sql_rounded("hr_total steps_total", """SELECT CAST(user_key AS INTEGER) AS user_key, count(*) AS n, count(hr) AS hr_count, sum(CAST(hr AS FLOAT)::DOUBLE) AS hr_total,
         sum(CAST(steps AS FLOAT)::DOUBLE) AS steps_total, min(time) AS first_time FROM raw_minutes GROUP BY user_key""", 3),
    "raw_minutes",
)
def _(spark, d):
    folder = T.scratch_dir(spark)
    raw = V.raw_minutes(spark, d)
    paths = []
    for part in range(3):
        path = f"{folder}/smartwatch{part}"
        raw.filter(F.col("user_key") % 3 == part).write.option("nullValue", "NA").csv(path, header=True)
        paths.append(path)
    read = T.read_smartwatch(spark, paths)
    return rounded(read.groupBy("user_key").agg(
        F.count("*").alias("n"), F.count("hr").alias("hr_count"), F.sum(F.col("hr").cast("double")).alias("hr_total"),
        F.sum(F.col("steps").cast("double")).alias("steps_total"), F.min("time").alias("first_time"),
    ), 3)


WEEKLY_ORDER = ["user_key", "date", *S.SYMPTOM_COLUMNS, *S.DIRECT_EVENT_FIELDS, "weekly_oral"]


@query("src_02_questionnaire_csv", "SELECT * REPLACE (CAST(user_key AS INTEGER) AS user_key) FROM weekly", "weekly")
def _(spark, d):
    path = f"{T.scratch_dir(spark)}/weekly"
    V.weekly(spark, d).select(*WEEKLY_ORDER).write.option("nullValue", "NA").csv(path, header=True)
    return T.read_weekly(spark, path)


@query(
    "src_03_source_csv",
    """SELECT CAST(user_key AS INTEGER) AS user_key, date, hour, name, count(*) AS n FROM inhaler GROUP BY ALL""",
    "inhaler",
)
def _(spark, d):
    path = f"{T.scratch_dir(spark)}/inhaler"
    V.inhaler(spark, d).write.option("nullValue", "NA").csv(path, header=True)
    return T.read_csv(spark, path, S.INHALER).groupBy("user_key", "date", "hour", "name").agg(F.count("*").alias("n"))


@query(
    "src_04_parquet_scan",
    sql_rounded("hr_total", "SELECT user_key, count(*) AS n, sum(hr) AS hr_total FROM minutes GROUP BY user_key"),
    "minutes",
)
def _(spark, d):
    path = f"{T.scratch_dir(spark)}/minutes"
    T.write_parquet(minutes(spark, d), path)
    return rounded(spark.read.parquet(path).groupBy("user_key").agg(F.count("*").alias("n"), F.sum("hr").alias("hr_total")))


@query("src_05_parquet_or_csv", "SELECT * REPLACE (CAST(user_key AS INTEGER) AS user_key) FROM weekly", "weekly")
def _(spark, d):
    folder = T.scratch_dir(spark)
    V.weekly(spark, d).select(*WEEKLY_ORDER).write.option("nullValue", "NA").csv(f"{folder}/weekly_csv", header=True)
    return T.read_parquet_or_csv(spark, f"{folder}/weekly_parquet", f"{folder}/weekly_csv", S.WEEKLY)


@query(
    "src_08_optional_sources",
    """SELECT user_key, count(*) AS n, count(smartinhaler_total_actuations) AS inhaler_days FROM
         (SELECT * FROM smartinhaler_daily UNION ALL BY NAME SELECT * FROM peakflow_daily) GROUP BY user_key""",
    "smartinhaler_daily peakflow_daily",
)
def _(spark, d):
    folder = T.scratch_dir(spark)
    T.write_parquet(D.inhaler_daily(V.inhaler(spark, d)), f"{folder}/inhaler")
    T.write_parquet(D.peakflow_daily(V.peakflow(spark, d), V.patient(spark, d)), f"{folder}/peakflow")
    both = T.read_optional(spark, [f"{folder}/{n}" for n in ("inhaler", "environment", "peakflow")])
    return union_present([both]).groupBy("user_key").agg(
        F.count("*").alias("n"), F.count("smartinhaler_total_actuations").alias("inhaler_days")
    )


@query("snk_01_parquet_write", "SELECT * FROM weekly_events", "weekly_events")
def _(spark, d):
    path = f"{T.scratch_dir(spark)}/weekly_events"
    T.write_parquet(L.weekly_events(V.weekly(spark, d)), path)
    return spark.read.parquet(path)


@query("snk_02_csv_write", "SELECT user_key, date, doc_flag, broad_event_week, week_start_day FROM weekly_events", "weekly_events")
def _(spark, d):
    path = f"{T.scratch_dir(spark)}/weekly_events_csv"
    cols = ["user_key", "date", "doc_flag", "broad_event_week", "week_start_day"]
    T.write_report_csv(L.weekly_events(V.weekly(spark, d)).select(*cols), path)
    schema = "user_key BIGINT, date INT, doc_flag BOOLEAN, broad_event_week BOOLEAN, week_start_day INT"
    return spark.read.schema(schema).csv(path, header=True)
