"""The whole training table: all grid cells, four sources, static block; values are compared in test_catalogue."""

import os

import pytest

from cohortlake import catalogue
from cohortlake.plans import features as X

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")


def test_the_manifest_has_all_cells_and_sources(spark):
    got = catalogue.QUERIES["agg_19_coverage_manifest_whole"](spark, DATA)
    assert {f"{s}_day_coverage_mean" for s in X.SOURCES} <= set(got.columns)
    assert got.count() == 27


def test_statistics_are_finished_once_per_window(spark):
    from pyspark.sql import functions as F

    cells = [(u, 10, 4, 9, t, 6, w, 0) for u in (1, 2) for t in (2, 3) for w in (0, 7)]
    samples = spark.createDataFrame(cells, "user_key bigint, sample_anchor_day int, window_start_day int, window_end_day int, threshold int, input_length_days int, washout_days int, target int")
    daily = {"peakflow": spark.createDataFrame([(1, 5, 1.25), (1, 7, 2.5)], "user_key bigint, date int, pef double")}
    sizes = []
    table = X.training_table(samples, daily, sources=["peakflow"], finish=lambda t: sizes.append(t.count()) or t.withColumn("pef_window_sum", F.col("pef_window_sum") + 1))
    got = table.collect()
    assert sorted((r.user_key, r.pef_window_sum) for r in got) == [(1, 4.75)] * 4 + [(2, None)] * 4
    assert sizes == [2]  # two windows, eight samples


def test_wide_rows_are_written_by_cell_without_a_shuffle(spark, tmp_path):
    from pyspark.sql import functions as F

    from cohortlake.sources.tables import GRID_KEYS, write_grid

    rows = spark.range(0, 270, 1, 3).select("id", (F.col("id") % 3).alias("threshold"), (F.col("id") % 2).alias("input_length_days"), F.lit(7).alias("washout_days"))
    write_grid(rows.withColumn("task", F.spark_partition_id()), f"{tmp_path}/cells", gather=False)
    back = spark.read.parquet(f"{tmp_path}/cells")
    assert back.groupBy(*GRID_KEYS).count().count() == 6 and back.count() == 270
    files = back.withColumn("file", F.input_file_name()).groupBy("file").agg(F.countDistinct("task").alias("tasks"))
    assert {r.tasks for r in files.collect()} == {1} and files.count() == 18  # each task wrote its own rows of each cell


SAMPLE = "user_key bigint, sample_anchor_day int, window_start_day int, window_end_day int, threshold int, input_length_days int, washout_days int, target int"


def test_wide_rows_meet_no_shuffle_and_keep_loose_and_repeated_samples(spark):
    cells = [(1, 10, 4, 9, t, 6, 0, 1) for t in (2, 3, 3)] + [(None, 10, 4, 9, 2, 6, 0, 0), (2, 10, None, 9, 2, 6, 0, 0), (3, 99, 4, 98, 4, 95, 7, 0)]
    samples = spark.createDataFrame(cells, SAMPLE)
    daily = {
        "smartinhaler": spark.createDataFrame([(1, 5, 3), (None, 5, 7), (3, 98, 1)], "user_key bigint, date int, puffs int"),
        "peakflow": spark.createDataFrame([(1, 5, 1.25), (1, 9, 2.5), (3, 4, float("nan"))], "user_key bigint, date int, pef double"),
    }
    static = spark.createDataFrame([(1, "a"), (2, "b")], "user_key bigint, patient_sex string")
    table = X.training_table(samples, daily, static, ["smartinhaler", "peakflow"], decimals=(1, 1e-9))
    assert table.columns[:8] == samples.columns and table.columns[-1] == "patient_sex"
    got = sorted([(r.user_key, r.window_start_day, r.threshold, r.puffs_window_sum, r.pef_window_mean, r.peakflow_days_observed, r.patient_sex) for r in table.collect()], key=str)
    assert got == sorted([
        (1, 4, 2, 3.0, 1.9, 2.0, "a"), (1, 4, 3, 3.0, 1.9, 2.0, "a"), (1, 4, 3, 3.0, 1.9, 2.0, "a"),
        (None, 4, 2, None, None, None, None), (2, None, 2, None, None, None, "b"), (3, 4, 4, 1.0, None, 1.0, None),
    ], key=str)
    whole = X.training_table(samples.filter("user_key = 1"), daily, static, ["smartinhaler", "peakflow"])
    above = whole._jdf.queryExecution().sparkPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert "Join" not in above and "Generate" in above


def test_blocks_of_many_users_are_one_group_and_give_their_own_windows(spark, monkeypatch):
    import numpy as np

    from cohortlake.operators import windows as WN

    monkeypatch.setattr(WN, "STEP_VALUES", 300)
    rng = np.random.default_rng(5)
    rows = [(int(u), int(d), float(rng.integers(0, 9)) / 4) for u in range(25) for d in rng.permutation(120)[:50]]
    spans = {(int(u), int(e) - n + 1, int(e)) for u in range(5, 30) for n in (3, 7) for e in rng.integers(0, 120, 12)}
    samples = spark.createDataFrame(sorted(spans), "user_key bigint, window_start_day int, window_end_day int")
    blocks = WN.window_blocks(samples, {"peakflow": spark.createDataFrame(rows, "user_key bigint, date int, pef double")})
    plan = blocks._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapGroupsInArrow [part#" in plan
    got = {(r.user_key, r.window_start_day, r.window_end_day): r for r in blocks.collect()}
    assert set(got) == spans
    for (u, a, b), r in got.items():
        x = [v for w, d, v in rows if w == u and a <= d <= b]
        assert r.peakflow_days_observed == len(x)
        want = [sum(x), np.mean(x), np.std(x), min(x), max(x)] if x else [None] * 5
        for stat, w in zip(WN.STATS, want):
            value = r[f"pef_window_{stat}"]
            assert value is None if w is None else abs(value - w) < 1e-9


def test_wide_cells_are_stored_without_dictionaries(spark, tmp_path):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from cohortlake.sources.tables import write_grid

    rows = spark.range(0, 9000, 1, 1).select((F.col("id") % 1000 / 7).alias("x"), *[F.lit(2).alias(k) for k in ("threshold", "input_length_days", "washout_days")])
    for gather in (False, True):
        write_grid(rows, f"{tmp_path}/{gather}", gather=gather)
        files = list((tmp_path / str(gather)).rglob("*.parquet"))
        column = pq.ParquetFile(files[0]).metadata.row_group(0).column(0)
        assert len(files) == 1 and column.has_dictionary_page == gather and column.compression == "ZSTD"
