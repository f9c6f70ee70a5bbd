"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

A document's rate is the least change, in relative entropy, from one copy each that gives every source its token
target with no rate above ``CEILING``. Its dual is convex with one multiplier per source, and its solution tilts rates
exponentially in document size: min(CEILING, exp(multiplier * size)). Newton steps are aggregations over a
(source, size) table of counts, which follows the number of different sizes and not that of documents. Rates become
whole copies so that sums over sizes, from the largest down, are off by half a copy at most; what a source still lacks
is filled by copies of documents that fit, and the rest, less than any copy left, by a part of one document's copy.

Rates are whole multiples of 1 / ``UNIT`` and all sums exact integers, so that reruns agree whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortlake.llm import common

WEIGHTS = (3.0, 1.0, 2.0)  # by the sources' order, repeating
SHARE = 1.5  # tokens of the mix over tokens of the documents
CEILING = 2  # copies of a document, and of a source, at most
UNIT = 10_000_000
CLOSE = 1e-6  # of a source's words: Newton steps end there
STEPS = 200  # a bisection in between halves the bracket, so fewer steps end any search; more are an error


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(common.words_column(text)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, weights: Sequence[float] = WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """``sources(source, place, source_size)`` with ``target``: weighted shares that stop at ``ceiling`` sizes.

    Capped shares are taken out and the rest is shared anew until none is above its cap; one row per round reaches
    the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * ceiling
    table = sources.withColumn("weight", weight).withColumn("cap", cap)
    goal = share * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        over = F.col("weight") * level > F.col("cap")
        fixed, free = table.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        risen = (goal - fixed) / free if free else level
        if risen <= level:
            break
        level = risen
    return table.withColumn("target", F.least(F.col("weight") * level, "cap")).drop("weight", "cap")


def _rate(multiplier: Column, x: Column) -> Column:
    """A document's rate in units. exp() of large values is infinite, which ``least`` takes."""
    return F.round(F.least(F.exp(multiplier * x), F.lit(float(CEILING))) * UNIT).cast("long")


def multipliers(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, multiplier, scale) that meet the targets, by Newton steps of all sources at once.

    ``counts`` has (source, size, n) with sizes above zero. At the ceiling (target at ``CEILING`` times the size) the
    multiplier is infinite. Steps go by the logarithm of the tokens taken, which is closer to linear than the tokens;
    one that leaves the bracket of the root is replaced by its middle.
    """
    bounds = counts.groupBy("source").agg(F.min("size").alias("least"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    bounds = bounds.withColumnRenamed("source", "source_")
    start = sources.join(bounds, common.same(sources, bounds, ["source"])).drop("source_")
    ratio = F.col("target") / F.col("source_size")
    # Every rate is beyond the wanted ratio where that of the smallest document has reached it.
    edge = F.log(ratio) / (F.col("least") / F.col("scale"))
    done = (ratio >= CEILING) | (F.col("target") <= 0)
    state = common.stage(
        start.select(
            "source", "scale", "target", "source_size",
            F.when(ratio >= CEILING, float("inf")).when(F.col("target") <= 0, float("-inf")).otherwise(0.0).alias("multiplier"),
            F.least(edge, F.lit(0.0)).alias("low"), F.greatest(edge, F.lit(0.0)).alias("high"), done.alias("done"),
        )
    )
    for _ in range(STEPS):
        if not state.filter("not done").limit(1).count():
            return state.select("source", "multiplier", "scale")
        state = common.stage(_newton(counts, state))
    raise RuntimeError(f"no balance after {STEPS} steps")


def _newton(counts: DataFrame, state: DataFrame) -> DataFrame:
    now = state.withColumnRenamed("source", "source_")
    x = F.col("size") / F.col("scale")
    rate = _rate(F.col("multiplier"), x)
    terms = counts.join(now.filter("not done"), common.same(counts, now, ["source"])).select("source", "size", "n", "scale", rate.alias("rate"))
    tokens = (F.col("size") * F.col("n")).cast("decimal(20,0)") * F.col("rate").cast("decimal(18,0)")
    slope = F.when(F.col("rate") < CEILING * UNIT, tokens * F.col("size").cast("decimal(10,0)"))
    sums = terms.groupBy("source").agg(F.sum(tokens).cast("double").alias("taken"), F.sum(slope).cast("double").alias("slope"))
    sums = sums.withColumnRenamed("source", "source_")
    met = state.join(sums, common.same(state, sums, ["source"]), "left").drop("source_")
    taken, goal = F.col("taken") / UNIT, F.col("target")
    low = F.when(taken < goal, F.col("multiplier")).otherwise(F.col("low"))
    high = F.when(taken < goal, F.col("high")).otherwise(F.col("multiplier"))
    met = met.withColumns({"low": F.coalesce(low, "low"), "high": F.coalesce(high, "high")})
    steep = F.try_divide(F.col("taken"), F.col("slope") / F.col("scale"))
    step = F.col("multiplier") + F.log(F.try_divide(goal, taken)) * steep
    middle = (F.col("low") + F.col("high")) / 2
    inside = (step > F.col("low")) & (step < F.col("high"))
    ends = (F.abs(taken - goal) <= CLOSE * F.col("source_size")) | (F.col("high") - F.col("low") < 1e-14 * F.abs(middle))
    ended = F.col("done") | F.coalesce(ends, F.lit(False))
    moved = F.when(ended, F.col("multiplier")).when(inside, step).otherwise(middle)
    return met.withColumns({"multiplier": moved, "done": ended}).drop("taken", "slope")


def copies(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """``counts`` with ``copies``: of all its documents together, so that each source's tokens meet the target."""
    found = multipliers(counts.filter("size > 0"), sources).withColumnRenamed("source", "source_")
    x = F.col("size") / F.col("scale")
    tilted = counts.join(found, common.same(counts, found, ["source"]), "left").withColumn(
        "rate", F.when(F.col("size") > 0, _rate(F.col("multiplier"), x)).otherwise(F.lit(UNIT).cast("long"))
    )
    # A source has as many rows here as different sizes.
    sums = F.sum(F.col("rate") * F.col("n")).over(W.partitionBy("source").orderBy(F.desc("size")))
    half = UNIT // 2
    up_to = F.expr(f"(sums + {half}) div {UNIT}")
    before = F.expr(f"(sums - rate * n + {half}) div {UNIT}")
    cells = tilted.withColumn("sums", sums).select("source", "size", "n", (up_to - before).alias("copies"))
    return _remainder(_fill(common.stage(cells), sources), sources)


def _off(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """``cells`` that have words, with ``off``, what their source lacks."""
    goals = sources.select(F.col("source").alias("source_"), F.round("target").cast("long").alias("goal"))
    sums = cells.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("sum"))
    off = sums.join(goals, common.same(sums, goals, ["source"])).select("source_", (F.col("goal") - F.col("sum")).alias("off"))
    room = F.when(F.col("off") > 0, CEILING * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    return cells.join(off, common.same(cells, off, ["source"])).filter("size > 0").withColumn("room", room)


def _remainder(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """``cells`` with ``part``, words that one of its documents gives more or, below zero, less than whole copies."""
    able = _off(cells, sources).filter("off <> 0 AND room > 0 AND size > abs(off)")
    one = able.groupBy("source").agg(F.min(F.struct("size", F.col("off").alias("part"))).alias("one"))
    one = one.select(F.col("source").alias("source_"), F.col("one.size").alias("size_"), "one.part")
    return cells.join(one, common.same(cells, one, ["source", "size"]), "left").select(
        "source", "size", "n", "copies", F.coalesce("part", F.lit(0)).cast("long").alias("part")
    )


def _fill(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """``cells`` with copies added or taken away where a source is off its target by a document that fits.

    A round goes through a source's sizes from the largest that fits down, as far as their room in words lasts; what
    is left is less than the size where it stops, so sizes that fit shrink and few rounds are needed.
    """
    down = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    while True:
        fitting = _off(cells, sources).filter("room > 0 AND size <= abs(off)")
        left = F.abs("off") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(down), F.lit(0))
        fits = F.least(F.greatest(F.col("left"), F.lit(0)), F.col("room") * F.col("size"))
        moves = fitting.withColumn("left", left).withColumn("words", fits).selectExpr(
            "source AS source_", "size AS size_", "CAST(signum(off) AS BIGINT) * (words div size) AS move"
        )
        moves = common.stage(moves.filter("move <> 0"))
        if not moves.limit(1).count():
            return cells
        more = F.coalesce(F.col("move"), F.lit(0))
        cells = common.stage(
            cells.join(moves, common.same(cells, moves, ["source", "size"]), "left").select("source", "size", "n", (F.col("copies") + more).alias("copies"))
        )


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, part) per row: ``taken`` words are ``copies`` of the text and ``part``.

    Documents of one source and size have equal rates; which of them get the odd copies follows from a hash of id and
    text, and rows that repeat both share copies by their place in the table. A null source is one of its own, a null
    text has no words; a document without words keeps the rate of one copy and takes none. ``part`` is what one
    document of a source gives beyond its whole copies, or short of them, so that a source with documents meets its
    target to the word. Long texts are counted whole; an empty table gives no rows; other columns take no part.
    """
    slim = common.stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), common.row_key().alias("key")))
    counts = common.stage(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sums = common.stage(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    sources = common.stage(targets(common.numbered(sums, [], [F.col("source").isNull(), F.col("source")])))
    cells = copies(counts, sources)
    shares = sources.select(F.col("source").alias("source_"), "source_size", "target")
    cells = cells.join(shares, common.same(cells, shares, ["source"])).select("source", "size", "copies", "part", "source_size", "target")
    placed = common.numbered(slim, ["source", "size"], [F.col("key"), F.col("doc_id")], common.stage(cells))
    own = F.expr("copies div of") + (F.col("place") < F.col("copies") % F.col("of")).cast("long")
    # The first document without an odd copy gives more, the first of all gives less.
    giver = F.when(F.col("part") > 0, F.col("copies") % F.col("of")).otherwise(0)
    part = F.when(F.col("place") == giver, F.col("part")).otherwise(F.lit(0).cast("long"))
    return placed.select(
        "doc_id", "size", "source_size", "target", (own * F.col("size") + part).alias("taken"), own.alias("copies"), part.alias("part")
    )
