"""A gathered cell is sorted by one task per file, so a file must not hold more rows than a task sorts in little memory."""

from pyspark.sql import functions as F

from cohortlake import settings
from cohortlake.sources import tables


def test_a_large_cell_is_written_by_several_tasks(spark, tmp_path):
    settings.apply(spark)
    text = F.concat(*[F.sha2((F.col("id") * 4 + k).cast("string"), 256) for k in range(2)])
    rows = spark.range(0, 360_000, 1, 8).select(
        F.lit(2).alias("threshold"), F.lit(7).alias("input_length_days"), F.lit(0).alias("washout_days"), "id", text.alias("text")
    )
    tables.write_grid(rows, f"{tmp_path}/cells")
    cells = list((tmp_path / "cells").rglob("*.parquet"))
    assert len(cells) > 1
    back = spark.read.parquet(f"{tmp_path}/cells")
    assert back.agg(F.count("*"), F.countDistinct("id")).first()[:] == (360_000, 360_000)
