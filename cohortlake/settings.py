"""Session settings that the jobs rely on when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import SparkSession

SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split an oversized join partition even where that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Without this a join on user leaves its partitioning in place for a later grouping by (user, day), and all
    # days of a hot user stay in one task. With it the grouping shuffles on all its keys.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    # Parquet files of days and small numbers are a few hundred times smaller than their rows, and the planner counts
    # neither that nor an explode behind the scan or the shuffle: by file size only what is tiny is broadcast, the rest
    # by the bytes that its shuffle has measured, with room for both.
    "spark.sql.autoBroadcastJoinThreshold": "16k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m",
    # Shuffled bytes are compressed: rows of samples take thirteen times as much where a task sorts them to write them by
    # cell. Gathered and split partitions are cut at this size.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def apply(spark: SparkSession) -> SparkSession:
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark
