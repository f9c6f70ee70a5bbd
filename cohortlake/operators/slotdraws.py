"""Row bootstraps whose draws are an MD5 of seed, draw and slot, as SQL can say them, without a row per draw.

Slot s of draw d takes row ``md5(seed:d:s) % size``. Draws are computed by blocks of slots and packed, two bytes each,
by bands of row numbers; where a band meets its rows, the packed draws become one vector of counts per row. Rows then
meet by blocks of scores, as in ``splittree``: what is shuffled per block are two totals a draw.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlake.operators import splittree
from cohortlake.operators.ordering import integer_levels, running_totals, score_levels
from cohortlake.operators.splittree import BLOCK, _fields, _frame, _metrics
from cohortlake.sources.tables import materialize

# Python workers need not have this package: what a task calls from here travels with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(splittree)

SLOTS = 2**16  # slots whose draws are computed together
CHUNK = 2**7  # draws computed together
BAND = 2**9  # row numbers that meet in one group; with CHUNK, 16 bits

# Constants of MD5
START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def _md5_heads(head: bytes, numbers: np.ndarray) -> np.ndarray:
    """First 64 bits of the MD5 of ``head`` and each number, all with the same count of digits: 0.4 us each, one by one 2 to 3 us."""
    digits = len(str(int(numbers[0])))
    width = len(head) + digits
    if width > 55:  # more than one block of MD5
        return np.array([int.from_bytes(hashlib.md5(head + b"%d" % n).digest()[:8], "big") for n in numbers], np.uint64)
    text = np.zeros((len(numbers), 64), np.uint8)
    text[:, : len(head)] = np.frombuffer(head, np.uint8)
    for j in range(digits):
        text[:, width - 1 - j] = 48 + numbers // 10**j % 10
    text[:, width] = 128
    text[:, 56:] = np.frombuffer((8 * width).to_bytes(8, "little"), np.uint8)
    words = np.ascontiguousarray(text.view("<u4").T)
    a, b, c, d = (np.full(len(numbers), x, np.uint32) for x in START)
    for i in range(64):
        if i < 16:
            f, word = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, word = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, word = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, word = c ^ (b | ~d), 7 * i % 16
        f = f + a + words[word] + SINES[i]
        turn = TURNS[i // 16][i % 4]
        a, b, c, d = d, b + ((f << turn) | (f >> (32 - turn))), b, c
    ends = np.stack([a + START[0], b + START[1]], axis=1).astype("<u4")
    return ends.view(">u8").ravel().astype(np.uint64)


def drawn_rows(seed: int | str, draw: int, first: int, until: int, size: int) -> np.ndarray:
    """The rows that slots first..until-1 take: the first 15 hex digits of the MD5, modulo ``size``; as ``exprs.hash_index``."""
    head = f"{seed}:{draw}:".encode()
    tens = [10**k for k in range(1, 19) if first < 10**k < until]
    cuts = sorted({*range(first, until, 8192), *tens, until})
    heads = np.concatenate([_md5_heads(head, np.arange(a, b)) for a, b in zip(cuts, cuts[1:])])
    return (heads >> np.uint64(4)).astype(np.int64) % size


def packed_draws(numbered: DataFrame, keys: Sequence[str], n_boot: int, seed: int | str, slots: int = SLOTS) -> DataFrame:
    """All draws as (keys, band, draw, codes): ``codes`` holds two bytes per drawn slot, place in the band and draw
    after ``draw``. A task holds ``slots`` times CHUNK draws."""
    keys = list(keys)
    first, last = F.col("first"), F.col("last")
    # Row numbers of a group follow on one another, so its slots are a range.
    units = (
        numbered.groupBy(*keys, "size").agg((F.min("rn") - 1).alias("first"), (F.max("rn") - 1).alias("last"))
        .withColumn("slot", F.explode(F.sequence(first, last, F.lit(slots).cast("bigint"))))
        .withColumn("until", F.least(F.col("slot") + slots - 1, last) + 1)
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(CHUNK))))
        .repartition(4 * numbered.sparkSession.sparkContext.defaultParallelism)
    )

    def pack(batches):
        for units in batches:
            for unit in units.to_dict("records"):
                draws = range(unit["draw"], min(unit["draw"] + CHUNK, n_boot))
                rows = np.stack([drawn_rows(seed, d, unit["slot"], unit["until"], unit["size"]) for d in draws])
                codes = ((rows % BAND) * CHUNK + np.arange(len(draws))[:, None]).astype("<u2").ravel()
                bands = (rows // BAND).ravel()
                order = np.argsort(bands, kind="stable")
                bands, codes = bands[order], codes[order]
                starts = np.flatnonzero(np.diff(bands, prepend=-1))
                ends = [*starts[1:], len(bands)]
                out = {k: unit[k] for k in keys}
                yield pd.DataFrame(
                    {**{k: [v] * len(starts) for k, v in out.items()}, "band": bands[starts], "draw": unit["draw"],
                     "codes": [codes[a:b].tobytes() for a, b in zip(starts, ends)]}
                )

    schema = T.StructType([
        *[numbered.schema[k] for k in keys], T.StructField("band", T.LongType()),
        T.StructField("draw", T.IntegerType()), T.StructField("codes", T.BinaryType()),
    ])
    return units.select(*keys, "size", "slot", "until", "draw").mapInPandas(pack, schema)


def _placed(rows: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """(keys, y_prob, block, parts): blocks of up to ``block`` rows by descending score. A score that does not fit into one
    has an odd block of its own, in ``parts`` parts."""
    here = F.col("here")
    placed = running_totals(
        rows.groupBy(*keys, "y_prob").agg(F.count(F.lit(1)).alias("here")), keys,
        score_levels(F.col("y_prob"), descending=True), [F.col("y_prob").desc()], {"to": "here"},
    )
    first, last = F.floor((F.col("to") - here) / block), F.floor((F.col("to") - 1) / block)
    wide = first != last  # the only such score that starts in its block, after all others there
    return placed.select(
        *keys, "y_prob", (2 * first + wide.cast("int")).alias("block"), F.when(wide, F.ceil(here / block)).otherwise(1).alias("parts")
    )


def _counted(rows: DataFrame, packs: DataFrame, keys: Sequence[str], n_boot: int) -> DataFrame:
    """Rows with ``times``: how often each draw took the row, as unsigned numbers of one or eight bytes."""
    keep = [*keys, "block", "part", "y_prob", "y_true"]

    def count(key: tuple, held: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(c) // 2 for c in packed["codes"]]
        codes = np.frombuffer(b"".join(packed["codes"]), "<u2").astype(np.int64)
        draw = np.repeat(packed["draw"].to_numpy(np.int64), sizes) + codes % CHUNK
        times = np.bincount(codes // CHUNK * n_boot + draw, minlength=BAND * n_boot).reshape(BAND, n_boot)
        times = times[held["idx"].to_numpy(np.int64) % BAND]
        small = times.max(axis=1, initial=0) < 256
        out = held[keep].copy()
        out["times"] = [t.astype("<u1" if s else "<u8").tobytes() for t, s in zip(times, small)]
        return out

    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("times", T.BinaryType())])
    spot = [*keys, "band"]
    return rows.groupBy(*spot).cogroup(packs.groupBy(*spot)).applyInPandas(count, schema)


def _sums(cells: pd.DataFrame, n_boot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Drawn rows, positives and labelled rows of each score (by descending score) in each draw."""
    times = np.stack([np.frombuffer(t, "<u1" if len(t) == n_boot else "<u8").astype(np.int64) for t in cells["times"]])
    label = cells["y_true"].to_numpy(np.float64, na_value=np.nan)
    seen = ~np.isnan(label)
    _, at = np.unique(-cells["y_prob"].to_numpy(np.float64), return_inverse=True)
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
    fold = lambda weight: np.add.reduceat((times * weight[:, None])[order], starts, axis=0)
    return fold(np.ones(len(cells), np.int64)), fold(np.where(seen, label, 0).astype(np.int64)), fold(seen.astype(np.int64))


def row_metrics(
    numbered: DataFrame, keys: Sequence[str], n_boot: int, seed: int | str, block: int = BLOCK, slots: int = SLOTS
) -> DataFrame:
    """Metrics per (keys, draw): n, pos, roc_auc, pr_auc; NULL where undefined.

    ``numbered`` has ``rn`` (1-based), ``size``, ``y_true`` and ``y_prob``. Rows without a score are drawn, but count in no
    metric; a draw of such rows only is left out. A score whose drawn rows all lack a label gives no negatives.
    """
    keys = list(keys)
    spot = [*keys, "block"]
    idx = F.col("rn") - 1
    scored = numbered.filter(F.col("y_prob").isNotNull()).select(*keys, idx.alias("idx"), F.col("y_prob").cast("double").alias("y_prob"), "y_true")
    rows = (
        scored.join(_placed(scored, keys, block), [*keys, "y_prob"])
        .withColumns({"band": F.floor(F.col("idx") / BAND), "part": F.pmod(F.xxhash64("idx"), F.col("parts"))})
    )
    cells = materialize(_counted(rows, packed_draws(numbered, keys, n_boot, seed, slots), keys, n_boot))

    def totals(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows, ups, seen = (x.sum(axis=0) for x in _sums(part, n_boot))
        return _frame([*spot, "part"], key, n_boot, rows=rows, ups=ups, seen=seen)

    sums = ["rows", "ups", "seen"]
    per_block = (
        cells.groupBy(*spot, "part").applyInPandas(totals, _fields(cells, [*spot, "part"], ["draw", *sums]))
        .groupBy(*spot, "draw").agg(*[F.sum(c).alias(c) for c in sums])
    )
    offsets = running_totals(
        per_block, [*keys, "draw"], integer_levels(F.col("block")), [F.col("block")],
        {"rows_to": "rows", "ups_to": "ups", "seen_to": "seen"}, totals=True,
    )
    whole = F.col("block") % 2 == 0

    def terms(key: tuple, part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        before = before.sort_values("draw", ignore_index=True)
        rows, ups, seen = _sums(part, n_boot)
        ups_to = ups.cumsum(axis=0) + (before["ups_to"] - before["ups"]).to_numpy(np.int64)
        rows_to = rows.cumsum(axis=0) + (before["rows_to"] - before["rows"]).to_numpy(np.int64)
        roc = np.where(seen > 0, (rows - ups) * (ups_to - ups / 2.0), 0.0).sum(axis=0)
        pr = (ups * (ups_to / np.maximum(rows_to, 1))).sum(axis=0)
        return _frame(spot, key, n_boot, roc=roc, pr=pr)

    inside = cells.filter(whole).groupBy(*spot).cogroup(offsets.filter(whole).groupBy(*spot)).applyInPandas(
        terms, _fields(cells, spot, ["draw"], ["roc", "pr"])
    )
    ups, ups_to = F.col("ups"), F.col("ups_to")
    alone = offsets.filter(~whole).select(
        *spot, "draw", F.when(F.col("seen") > 0, (F.col("rows") - ups) * (ups_to - ups / 2.0)).otherwise(0.0).alias("roc"),
        F.when(ups > 0, ups * (ups_to / F.col("rows_to"))).otherwise(0.0).alias("pr"),
    )
    n, pos, seen = F.sum("rows").alias("n"), F.sum("ups").alias("pos"), F.sum("seen").alias("seen")
    whole_draw = per_block.groupBy(*keys, "draw").agg(n, pos, seen).filter("n > 0").select(
        *keys, "draw", "n", F.when(F.col("seen") > 0, F.col("pos")).alias("pos")
    )
    return _metrics(inside.unionByName(alone).join(whole_draw, [*keys, "draw"]), keys)
