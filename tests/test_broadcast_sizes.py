"""Days laid out from a small file are no small table: the planner must not broadcast them by the file's size."""

from pyspark.sql import functions as F

from cohortlake import settings
from cohortlake.operators import timejoin
from cohortlake.plans import samples


def test_laid_out_days_of_a_small_file_are_not_broadcast(spark, tmp_path):
    settings.apply(spark)
    spans = spark.range(150_000).select((F.hash("id") % 90_000).alias("user_key"), F.lit(0).alias("first"), F.lit(27).alias("last"))
    spans.repartition(1).write.parquet(f"{tmp_path}/spans")
    files = sum(f.stat().st_size for f in (tmp_path / "spans").glob("*.parquet"))
    assert 300_000 < files < 5_000_000
    days = timejoin.lay_out_days(spark.read.parquet(f"{tmp_path}/spans"), "first", "last")
    plan = days.join(days.withColumnRenamed("first", "begin"), ["user_key", "day"])._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_table_of_a_few_rows_is_still_broadcast(spark, tmp_path):
    settings.apply(spark)
    spark.range(1000).select((F.col("id") % 5).alias("k"), "id").write.parquet(f"{tmp_path}/rows")
    spark.range(5).select(F.col("id").alias("k")).write.parquet(f"{tmp_path}/few")
    plan = spark.read.parquet(f"{tmp_path}/rows").join(spark.read.parquet(f"{tmp_path}/few"), "k")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_days_of_a_file_below_the_former_limit_are_not_broadcast(spark, tmp_path):
    settings.apply(spark)
    spans = spark.range(150_000).select(F.col("id").alias("user_key"), F.lit(0).alias("first"), F.lit(27).alias("last"))
    spans.repartition(1).sortWithinPartitions("user_key").write.option("compression", "zstd").parquet(f"{tmp_path}/spans")
    files = sum(f.stat().st_size for f in (tmp_path / "spans").glob("*.parquet"))
    assert 20_000 < files < 250_000  # of 4,200,000 rows of days
    days = timejoin.lay_out_days(spark.read.parquet(f"{tmp_path}/spans"), "first", "last")
    plan = days.join(days.withColumnRenamed("first", "begin"), ["user_key", "day"])._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_sample_step_broadcasts_no_days_of_small_files(spark, tmp_path):
    settings.apply(spark)
    weeks = spark.range(150_000).select(
        F.hash("id").cast("bigint").alias("user_key"), F.lit(7).alias("week_start_day"), F.lit(13).alias("week_end_day"),
        F.lit(True).alias("has_valid_covered_days"), (F.col("id") % 3 == 0).alias("broad_event_week"),
        F.lit(2).alias("threshold"), F.lit(9).alias("event_day"), F.lit(9).alias("event_onset_day"), F.lit(9).alias("event_end_day"),
    )
    weeks.repartition(1).write.parquet(f"{tmp_path}/weeks")
    files = sum(f.stat().st_size for f in (tmp_path / "weeks").glob("*.parquet"))
    assert 300_000 < files < 5_000_000
    rows = spark.read.parquet(f"{tmp_path}/weeks")
    neg = samples.negative_candidates(rows, rows, rows, (2, 3), (7, 14), (0, 7))
    plan = neg._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
