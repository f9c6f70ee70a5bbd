"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortlake.llm import common


def _draw(key: Column, shard: int) -> Column:
    """Uniform number in (0, 1) from key and shard alone."""
    return (F.pmod(F.xxhash64(F.lit(shard), key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def shard_column(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score -weight / ln(draw); the lower number on a tie.

    A record's scores don't depend on the other shards. So a new shard takes records only into itself, in
    proportion to its weight, and a removed one gives away only its own.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be non-negative and one positive at least")
    scored = [
        F.struct((-F.lit(float(w)) / F.log(_draw(key, i))).alias("score"), F.lit(-i).alias("shard"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    return -(scored[0] if len(scored) == 1 else F.greatest(*scored))["shard"]


def assign(
    docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: key, size (UTF-8 bytes and 1), text_crc32, shard, slot and grown_shard (under ``grown`` weights).

    A null text counts as empty; rows of a null key share one shard, as rows of any other repeated key do. Slots
    number the rows of each shard from 0 without a gap. They are found without gathering a shard in one task: rows
    get their place in their input partition as the slim table is written, ranks are taken per (partition, shard),
    and sums over the partitions, of which there are few, place them.
    """
    body = common.text_or_empty(text)
    # Parquet holds strings as UTF-8, so length and checksum need no conversion of the text.
    slim = common.stage(
        docs.select(
            F.col(key),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            shard_column(F.col(key), weights).alias("shard"),
            (shard_column(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
            F.monotonically_increasing_id().alias("at"),
        ).withColumn("part", F.shiftright("at", 33))
    )
    counts = slim.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = slim.withColumn("rank", F.row_number().over(W.partitionBy("shard", "part").orderBy("at")))
    return ranked.join(starts, ["shard", "part"]).select(
        key, "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id") -> None:
    """The rows as one folder of files per shard; a large shard is written by several tasks."""
    out = docs.withColumn("shard", shard_column(F.col(key), weights))
    out.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
