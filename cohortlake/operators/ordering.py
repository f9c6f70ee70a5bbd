"""Ranks, running sums and exact quantiles that never hold one whole group in one task.

A plain ``row_number().over(partitionBy(key))`` sends a key to one task. Here the order is cut into
levels, each a coarser, order-preserving view of the sort key. Totals per level give the offset of every
bucket, and only rows of one (key, bucket) are sorted together. The level columns must be monotone in the
sort order, so that ordering by (levels, order) equals ordering by (order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortlake.functions.exprs import hash_order


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[Column],
    order: Sequence[Column],
    sums: dict[str, str | Column],
    totals: bool = False,
) -> DataFrame:
    """Add inclusive running sums. ``sums`` maps output name to the summed column.

    With ``totals`` the sum of the whole key group comes along as ``<name>_total``: the coarsest level has
    it anyway. Keys and levels must not be NULL.
    """
    keys = list(keys)
    names = [f"_lv{i}" for i in range(len(levels))]
    inputs = {f"_in_{out}": src for out, src in sums.items()}
    base = df.select(
        "*",
        *[c.alias(n) for c, n in zip(levels, names)],
        *[(F.col(s) if isinstance(s, str) else s).alias(n) for n, s in inputs.items()],
    )
    per_level = {}
    source = base
    for depth in range(len(names), 0, -1):
        # Each coarser level sums the next finer one, so the rows themselves are totalled once.
        source = source.groupBy(*keys, *names[:depth]).agg(*[F.sum(n).alias(n) for n in inputs])
        per_level[depth] = source
    offsets = None
    for depth in range(1, len(names) + 1):
        group = W.partitionBy(*keys, *names[: depth - 1])
        before = group.orderBy(names[depth - 1]).rowsBetween(W.unboundedPreceding, -1)
        cols = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_{depth}") for n in inputs]
        if depth == 1 and totals:
            cols += [F.sum(n).over(group).alias(f"{n}_total") for n in inputs]
        step = per_level[depth].select(*keys, *names[:depth], *cols)
        offsets = step if offsets is None else step.join(offsets, keys + names[: depth - 1])
    inside = W.partitionBy(*keys, *names).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = base.select("*", *[F.sum(n).over(inside).alias(f"{n}_0") for n in inputs])
    joined = local.join(offsets, keys + names)
    outs = []
    for out, n in zip(sums, inputs):
        total = F.col(f"{n}_0")
        for depth in range(1, len(names) + 1):
            total = total + F.col(f"{n}_{depth}")
        outs.append(total.alias(out))
        if totals:
            outs.append(F.col(f"{n}_total").alias(f"{out}_total"))
    return joined.select(*df.columns, *outs)


def integer_levels(c: Column) -> list[Column]:
    """Levels for a non-negative integer sort key, dense or sparse: no band holds more than 2**15 of the next level's."""
    return [F.shiftright(c.cast("bigint"), bits) for bits in (48, 36, 24, 12)]


# Bands of a score, from the smallest up: how many each stretch of [0, 1] has. The stretches end where a score or its
# distance from 1 is a power of two.
RARE, TINY = 10, 70  # 2**-10 and 2**-70
TINY_BANDS, RARE_BANDS, SURE_BANDS = 2**6, 2**12, 2**12  # per octave: below TINY, from TINY to RARE, above 1 - 2**-RARE
MIDDLE_BANDS = 2**19  # per unit in between


def score_levels(c: Column, descending: bool = False) -> list[Column]:
    """About a million bands for a score: equal ones in the middle of [0, 1] and logarithmic ones towards both ends.

    So scores of rare events, which crowd below any fixed width, are spread as well. A key meets at most its bands in
    one task, never its rows. Numbers outside (0, 1) get whole bands of their own, in order.
    """
    c = c.cast("double")
    tiny = (1100 - TINY) * TINY_BANDS
    rare = tiny + (TINY - RARE) * RARE_BANDS
    middle = rare + MIDDLE_BANDS
    sure = middle + (53 - RARE + 1) * SURE_BANDS
    low, high = F.log2(c), -F.log2(1 - c)
    band = (
        F.when(c <= 0, F.floor(c) - 1)
        .when(c < 2.0**-TINY, F.floor((low + 1100) * TINY_BANDS))
        .when(c < 2.0**-RARE, tiny + F.floor((low + TINY) * RARE_BANDS))
        .when(c < 1 - 2.0**-RARE, rare + F.floor((c - 2.0**-RARE) * MIDDLE_BANDS))
        .when(c < 1, middle + F.floor((high - RARE) * SURE_BANDS))
        .otherwise(sure + F.floor(c))
    )
    return [-band if descending else band]


def value_levels(c: Column) -> list[Column]:
    """Log-spaced bands for any finite double, 65536 per octave."""
    return [F.floor(F.signum(c) * F.log2(1 + F.abs(c)) * 65536)]


def number_rows(
    df: DataFrame, keys: Sequence[str], levels: Sequence[Column], order: Sequence[Column], out: str = "rn"
) -> DataFrame:
    """1-based row number per key group."""
    return running_totals(df, keys, levels, order, {out: F.lit(1).cast("bigint")})


def number_by_hash(df: DataFrame, keys: Sequence[str], ident: Sequence[str], seed: int | str, out: str = "rn") -> DataFrame:
    """1-based row number in seeded MD5 order; ``ident`` must identify a row inside its group."""
    h = hash_order(seed, *ident)
    return number_rows(df, keys, [F.substring(h, 1, 5)], [h, *[F.col(i) for i in ident]], out)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    freq: str | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per key; NULL values are ignored, all-NULL groups drop out.

    Equal values are collapsed before the shuffle, so a hot group costs its distinct values only, and
    even those are spread over level buckets.
    """
    keys = list(keys)
    weight = F.sum(freq) if freq else F.count(F.lit(1))
    counts = (
        df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(weight.alias("_n"))
    )
    placed = running_totals(counts, keys, value_levels(F.col("_v")), [F.col("_v")], {"_cum": "_n"}, totals=True)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum")), F.col("_v")))

    aggs = []
    for name, p in probs.items():
        pos = (F.col("_cum_total") - 1) * F.lit(float(p))
        aggs += [at(F.floor(pos)).alias(f"{name}_lo"), at(F.ceil(pos)).alias(f"{name}_hi")]
    aggs.append(F.max("_cum_total").alias("_cum_total"))
    found = placed.groupBy(*keys).agg(*aggs)
    outs = []
    for name, p in probs.items():
        pos = (F.col("_cum_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return found.select(*keys, *outs)
