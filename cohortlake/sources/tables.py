"""Readers and writers. Nothing is collected; every path may be a shared store."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlake.sources import schemas as S

GRID_KEYS = ["threshold", "input_length_days", "washout_days"]


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint folder; an error where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back, where several jobs use the same rows.

    The files outlive lost executors, and the lineage ends at the scan.
    """
    path = f"{scratch_dir(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, so that counts and averages skip it."""
    kinds = dict(df.dtypes)
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("float", "double") else F.col(c) for c in df.columns]
    )


def require_columns(df: DataFrame, required: Sequence[str], what: str = "table") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise KeyError(f"{what} lacks columns {missing}")
    return df


def _typed(column: str, kind: str) -> Column:
    raw = F.col(column)
    if kind == "STRING":
        return raw
    if kind in ("INT", "SMALLINT", "BIGINT"):
        return raw.try_cast("double").try_cast(kind)  # '3.0' is how a whole number with gaps is often written
    return raw.try_cast(kind)


def read_csv(spark: SparkSession, path: str | Sequence[str], ddl: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV scan over one or many files. Columns are found by name in each file, so files may differ in column
    order and carry more columns than asked for; only the asked ones are parsed. Values that do not fit their
    type become NULL, and so do 'NA' and NaN. No inference pass runs.
    """
    kinds = dict(field.split(" ") for field in ddl.split(", "))
    wanted = list(columns) if columns else list(kinds)
    parts = []
    for p in [path] if isinstance(path, str) else path:
        raw = spark.read.option("nullValue", "NA").csv(p, header=True)
        require_columns(raw, wanted, p)
        parts.append(raw.select(*[_typed(c, kinds[c]).alias(c) for c in wanted]))
    return nan_to_null(reduce(lambda a, b: a.unionByName(b), parts))


def read_smartwatch(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return read_csv(spark, paths, S.SMARTWATCH)


def read_weekly(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.WEEKLY)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.DAILY)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_parquet_or_csv(spark: SparkSession, parquet: str, csv: str, ddl: str) -> DataFrame:
    """Parquet when it is there, else the CSV twin, else an error."""
    if path_exists(spark, parquet):
        return spark.read.parquet(parquet)
    if path_exists(spark, csv):
        return read_csv(spark, csv, ddl)
    raise FileNotFoundError(f"neither {parquet} nor {csv} exists")


def read_optional(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """Union of the Parquet tables that exist; absent ones are skipped."""
    found = [spark.read.parquet(p) for p in paths if path_exists(spark, p)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """CSV for result tables; partitions are kept, since a label table may be large."""
    df.write.mode("overwrite").csv(path, header=True)


def write_grid(df: DataFrame, path: str, gather: bool = True) -> None:
    """One folder per grid cell. The rebalance step gathers a cell's rows into few files and splits a large
    cell over several tasks, so there are neither tiny files nor a cell that needs one task. Wide rows whose tasks are
    large already are better written where they are (``gather`` False): a file per task and cell, nothing shuffled. Their
    statistics are doubles that seldom repeat, so they go without dictionaries, which Zstandard would have to see through.
    """
    laid = df.hint("rebalance", *GRID_KEYS) if gather else df
    writer = laid.write.mode("overwrite").option("compression", "zstd")
    if not gather:
        writer = writer.option("parquet.enable.dictionary", "false").option("parquet.compression.codec.zstd.level", "9")
    writer.partitionBy(*GRID_KEYS).parquet(path)


def read_grid(spark: SparkSession, path: str, keys: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Rows of the asked grid cells; raises and names every cell that is absent.

    ``keys`` is the caller's own short list, so it bounds what reaches the driver.
    """
    table = spark.read.parquet(path)
    asked = spark.createDataFrame([tuple(k) for k in keys], "threshold INT, input_length_days INT, washout_days INT")
    found = table.select(*GRID_KEYS).distinct()
    absent = asked.join(found, GRID_KEYS, "left_anti").orderBy(*GRID_KEYS).collect()
    if absent:
        raise FileNotFoundError(f"missing grid cells: {[tuple(r) for r in absent]}")
    hit = reduce(
        lambda a, b: a | b,
        [
            (F.col("threshold") == t) & (F.col("input_length_days") == n) & (F.col("washout_days") == w)
            for t, n, w in keys
        ],
    )
    return table.filter(hit)


def write_daily_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        write_parquet(table, f"{folder}/{name}_daily_features")


def read_daily_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}_daily_features") for n in names}


def write_split(split: DataFrame, path: str, user: str = "user_key") -> None:
    """Split manifest as JSON lines (split, user): one record per user, so no array grows with the cohort."""
    split.select(user, "split").write.mode("overwrite").json(path)


def read_split(spark: SparkSession, path: str, user: str = "user_key") -> DataFrame:
    return spark.read.schema(f"{user} BIGINT, split STRING").json(path)


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A hand-made manifest with three user arrays, laid out as (user_key, split)."""
    doc = spark.read.schema(S.SPLIT_MANIFEST).option("multiLine", True).json(path)
    arrays = F.array(
        *[F.struct(F.lit(n).alias("split"), F.col(f"{n}_users").alias("users")) for n in ("train", "val", "test")]
    )
    return (
        doc.select(F.explode(arrays).alias("s"))
        .select(F.explode("s.users").alias("user_key"), F.col("s.split").alias("split"))
    )
