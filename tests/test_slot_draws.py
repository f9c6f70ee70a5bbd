"""Row bootstraps by MD5 slots must equal the plain resampling, without a row per draw."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake import settings
from cohortlake.operators import resample, slotdraws


def plain_index(seed, draw, slot, size):
    return int(hashlib.md5(f"{seed}:{draw}:{slot}".encode()).hexdigest()[:15], 16) % size


@pytest.mark.parametrize("seed, first, until, size", [(42, 0, 1203, 1203), (7, 99_990, 100_010, 10**9), ("a" * 60, 5, 15, 97)])
def test_drawn_rows_are_those_of_the_md5(seed, first, until, size):
    got = slotdraws.drawn_rows(seed, 1999, first, until, size)
    assert got.tolist() == [plain_index(seed, 1999, s, size) for s in range(first, until)]


def plain_metrics(rows, draw, seed):
    """n, pos, ROC-AUC and average precision of one resample; labels may be None, a score of such rows only gives no negatives."""
    drawn = [rows[plain_index(seed, draw, s, len(rows))] for s in range(len(rows))]
    drawn = [r for r in drawn if r[1] is not None]
    n, pos = len(drawn), sum(y or 0 for y, _ in drawn)
    roc = pr = above = count = 0
    for p in sorted({p for _, p in drawn}, reverse=True):
        at = [y for y, q in drawn if q == p]
        ups = sum(y or 0 for y in at)
        count, above = count + len(at), above + ups
        if any(y is not None for y in at):
            roc += (len(at) - ups) * (above - ups / 2)
            pr += ups * above / count
    return n, pos, roc / (pos * (n - pos)), pr / pos


@pytest.mark.parametrize("block, slots", [(512, 2**16), (16, 100)])
def test_metrics_equal_plain_resampling(spark, frame, block, slots):
    settings.apply(spark)
    rng = np.random.default_rng(1)
    rows = [
        (int(y) if i % 17 else None, None if i % 29 == 0 else 0.5 if i % 3 == 0 else round(float(p), 2))
        for i, (y, p) in enumerate(zip(rng.random(700) < 0.3, rng.random(700)))
    ]
    table = frame([("a", i + 1, len(rows), y, p) for i, (y, p) in enumerate(rows)], "config STRING, rn BIGINT, size BIGINT, y_true INT, y_prob DOUBLE")
    out = slotdraws.row_metrics(table, ["config"], 140, 42, block, slots).orderBy("draw").collect()
    assert [r["draw"] for r in out] == list(range(140))
    for r in (out[0], out[77], out[139]):
        assert (r["n"], r["pos"], r["roc_auc"], r["pr_auc"]) == pytest.approx(plain_metrics(rows, r["draw"], 42))


def test_draws_are_packed_not_rows(spark):
    rows = spark.range(1, 20_001).select(F.lit("a").alias("config"), F.col("id").alias("rn"), F.lit(20_000).cast("bigint").alias("size"))
    packs = slotdraws.packed_draws(rows, ["config"], 130, 42)
    n, held = packs.agg(F.count("*"), F.sum(F.length("codes"))).first()
    assert held == 2 * 20_000 * 130 and n <= 2 * 40
    plan = resample.row_bootstrap(
        rows.select("config", F.col("rn").alias("id"), (F.col("rn") % 2).alias("y_true"), (F.col("rn") / 20_000).alias("y_prob")), ["config"], "id", 130
    )._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
