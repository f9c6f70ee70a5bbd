"""Bootstraps by a seeded binomial splitting tree: how often a row or user is drawn is computed where the row lies.

The rows of a config are numbered by score, and its ``n`` draws are split over [0, n) by halving: the left half of a
node gets a binomial share of the node's draws. Each node has a generator of its own, seeded by its ends, so any task
that walks to a node finds the same split, and the multiplicities of all rows are exactly multinomial. No draw becomes
a row: what is shuffled is the distinct scores (for users: their distinct scores), and per block two totals a draw.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlake.functions import exprs as E
from cohortlake.operators import ranking
from cohortlake.operators.ordering import integer_levels, number_by_hash, running_totals, score_levels

BLOCK = 512  # distinct scores, or (user, score) pairs, that one task holds beside all draws


def draws_below(bounds: np.ndarray, size: int, n_boot: int, seed: int) -> np.ndarray:
    """How many of ``size`` draws from 0..size-1 fall below each bound: one row per bound, one column per resample.

    ``bounds`` ascend and are distinct. Only nodes that hold a bound inside are split, whatever the size.
    """
    bounds = np.asarray(bounds, dtype=np.int64)
    below = np.zeros((len(bounds), n_boot), dtype=np.int64)
    below[bounds == size] = size
    first, last = np.searchsorted(bounds, 1), np.searchsorted(bounds, size)
    nodes = [(0, size, first, last, np.zeros(n_boot, np.int64), np.full(n_boot, size, np.int64))]
    while nodes:
        lo, hi, a, b, before, here = nodes.pop()  # bounds[a:b] lie inside lo < bound < hi
        if a == b:
            continue
        mid = (lo + hi) // 2
        key = hashlib.blake2b(f"{seed}:{lo}:{hi}".encode(), digest_size=16).digest()
        left = np.random.Generator(np.random.Philox(key=int.from_bytes(key, "big"))).binomial(here, (mid - lo) / (hi - lo))
        cut = a + int(np.searchsorted(bounds[a:b], mid))
        after = cut
        if cut < b and bounds[cut] == mid:
            below[cut] = before + left
            after = cut + 1
        nodes.append((lo, mid, a, cut, before, left))
        nodes.append((mid, hi, after, b, before + left, here - left))
    return below


def _drawn(cells: pd.DataFrame, n_boot: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Drawn rows and drawn positives of each score (rows of the block, by descending score) in each resample.

    The positives of a score have the first numbers of its range.
    """
    start = (cells["cum_n"] - cells["n_at"]).to_numpy(np.int64)
    middle, end = start + cells["pos_at"].to_numpy(np.int64), cells["cum_n"].to_numpy(np.int64)
    bounds = np.unique(np.concatenate([start, middle, end]))
    below = draws_below(bounds, int(cells["cum_n_total"].iloc[0]), n_boot, seed)
    at = lambda x: below[np.searchsorted(bounds, x)]
    return at(end) - at(start), at(middle) - at(start)


def row_bootstrap(preds: DataFrame, keys: Sequence[str], n_boot: int = 2000, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """Metrics per (keys, draw) of row-wise resamples: n, pos, roc_auc, pr_auc; NULL where undefined.

    Rows without a score are left out. Keys must not be NULL. The resamples depend on the seed, the number of resamples
    and the number of rows, not on partitions or blocks. An empty table gives no rows.
    """
    keys = list(keys)
    scores = ranking.by_score(preds, keys)
    placed = running_totals(
        scores, keys, score_levels(F.col("y_prob"), descending=True), [F.col("y_prob").desc()],
        {"cum_n": "n_at", "no": F.lit(1).cast("bigint")}, totals=True,
    )
    spot = [*keys, "block"]
    cells = placed.withColumn("block", F.floor((F.col("no") - 1) / block)).select(
        *spot, "y_prob", "n_at", "pos_at", "cum_n", "cum_n_total"
    )
    def drawn(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return _drawn(part.sort_values("cum_n", ignore_index=True), n_boot, seed)

    per_block = _totals(cells, spot, drawn, n_boot)
    return _metrics(_terms(cells, _offsets(per_block, keys, "block"), spot, drawn, n_boot), keys)


def user_bootstrap(
    preds: DataFrame, keys: Sequence[str], user: str, n_boot: int = 1000, seed: int = 42, block: int = BLOCK
) -> DataFrame:
    """Metrics per (keys, draw) when whole users are drawn with replacement: n, pos, roc_auc, pr_auc; NULL where undefined.

    Users are numbered by a seeded MD5; a user without any score is drawn too and brings no rows. Keys and user must
    not be NULL. Scores lie in blocks of up to ``block`` (user, score) pairs. A score that does not fit into one block, such as
    a default that most users share, is summed by parts of its users and needs no block.
    """
    keys = list(keys)
    users = preds.select(*keys, user).distinct()
    numbered = number_by_hash(users, keys, [user], "users").join(
        users.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")), keys
    )
    pairs = ranking.by_score(preds, [*keys, user])
    placed = running_totals(
        pairs.groupBy(*keys, "y_prob").agg(F.count(F.lit(1)).alias("here")), keys,
        score_levels(F.col("y_prob"), descending=True), [F.col("y_prob").desc()], {"to": "here"},
    )
    first, last = F.floor((F.col("to") - F.col("here")) / block), F.floor((F.col("to") - 1) / block)
    wide = first != last  # the only such score that starts in its block, after all others there
    scores = placed.select(
        *keys, "y_prob", (2 * first + wide.cast("int")).alias("block"),
        F.when(wide, F.ceil(F.col("here") / block)).otherwise(1).alias("parts"),
    )
    cells = (
        pairs.join(numbered, [*keys, user]).join(scores, [*keys, "y_prob"])
        .withColumn("part", F.pmod(F.xxhash64("rn"), F.col("parts")))
        .select(*keys, "block", "part", "y_prob", "rn", "size", "n_at", "pos_at")
    )
    whole = F.col("block") % 2 == 0

    def drawn(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        who = part["rn"].to_numpy(np.int64)
        bounds = np.unique(np.concatenate([who - 1, who]))
        below = draws_below(bounds, int(part["size"].iloc[0]), n_boot, seed)
        times = below[np.searchsorted(bounds, who)] - below[np.searchsorted(bounds, who - 1)]
        values, at = np.unique(-part["y_prob"].to_numpy(np.float64), return_inverse=True)
        rows, ups = np.zeros((len(values), n_boot), np.int64), np.zeros((len(values), n_boot), np.int64)
        np.add.at(rows, at, times * part["n_at"].to_numpy(np.int64)[:, None])
        np.add.at(ups, at, times * part["pos_at"].to_numpy(np.int64)[:, None])
        return rows, ups

    spot = [*keys, "block"]
    per_block = _totals(cells, [*spot, "part"], drawn, n_boot).groupBy(*spot, "draw").agg(
        F.sum("rows").alias("rows"), F.sum("ups").alias("ups")
    )
    offsets = _offsets(per_block, keys, "block")
    inside = _terms(cells.filter(whole), offsets.filter(whole), spot, drawn, n_boot)
    ups, ups_to = F.col("ups"), F.col("ups_to")
    alone = offsets.filter(~whole).select(
        *spot, "draw", F.col("rows_to_total").alias("n"), F.col("ups_to_total").alias("pos"),
        ((F.col("rows") - ups) * (ups_to - ups / 2.0)).alias("roc"),
        F.when(ups > 0, ups * (ups_to / F.col("rows_to"))).otherwise(0.0).alias("pr"),
    )
    return _metrics(inside.unionByName(alone), keys)


def _frame(spot: Sequence[str], key: tuple, n_boot: int, **cols) -> pd.DataFrame:
    out = pd.DataFrame({"draw": np.arange(n_boot), **cols})
    for i, name in enumerate(spot):
        out.insert(i, name, [key[i]] * n_boot)
    return out


def _fields(cells: DataFrame, spot: Sequence[str], longs: Sequence[str], doubles: Sequence[str] = ()) -> T.StructType:
    head = [cells.schema[c] for c in spot]
    return T.StructType([*head, *[T.StructField(c, T.LongType()) for c in longs], *[T.StructField(c, T.DoubleType()) for c in doubles]])


def _totals(cells: DataFrame, spot: Sequence[str], drawn, n_boot: int) -> DataFrame:
    """Drawn rows and positives per block and draw."""

    def totals(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows, ups = drawn(part)
        return _frame(spot, key, n_boot, rows=rows.sum(axis=0), ups=ups.sum(axis=0))

    return cells.groupBy(*spot).applyInPandas(totals, _fields(cells, spot, ["draw", "rows", "ups"]))


def _offsets(per_block: DataFrame, keys: Sequence[str], block: str) -> DataFrame:
    """Running totals of the blocks, per draw."""
    return running_totals(
        per_block, [*keys, "draw"], integer_levels(F.col(block)), [F.col(block)],
        {"rows_to": "rows", "ups_to": "ups"}, totals=True,
    )


def _terms(cells: DataFrame, offsets: DataFrame, spot: Sequence[str], drawn, n_boot: int) -> DataFrame:
    """Each block's summands of both metrics, per draw."""

    def terms(key: tuple, part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        before = before.sort_values("draw", ignore_index=True)
        rows, ups = drawn(part)
        ups_to = ups.cumsum(axis=0) + (before["ups_to"] - before["ups"]).to_numpy(np.int64)
        rows_to = rows.cumsum(axis=0) + (before["rows_to"] - before["rows"]).to_numpy(np.int64)
        roc = ((rows - ups) * (ups_to - ups / 2.0)).sum(axis=0)
        pr = (ups * (ups_to / np.maximum(rows_to, 1))).sum(axis=0)
        return _frame(spot, key, n_boot, n=before["rows_to_total"], pos=before["ups_to_total"], roc=roc, pr=pr)

    return cells.groupBy(*spot).cogroup(offsets.groupBy(*spot)).applyInPandas(
        terms, _fields(cells, spot, ["draw", "n", "pos"], ["roc", "pr"])
    )


def _metrics(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    n, pos = F.col("n"), F.col("pos")
    return (
        parts.groupBy(*keys, "draw", "n", "pos").agg(F.sum("roc").alias("roc"), F.sum("pr").alias("pr"))
        .select(
            *keys, F.col("draw").cast("int").alias("draw"), "n", "pos",
            F.when((pos > 0) & (pos < n), E.ratio(F.col("roc"), pos.cast("double") * (n - pos))).alias("roc_auc"),
            F.when(pos > 0, E.ratio(F.col("pr"), pos.cast("double"))).alias("pr_auc"),
        )
    )
