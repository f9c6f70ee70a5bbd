"""Sliding 24-hour windows over minute data and L-day windows over daily tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as WS, functions as F

from cohortlake.functions import exprs as E
from cohortlake.operators.ordering import exact_quantiles

USER, DATE, MINUTE = "user_key", "date", "relative_minute"


def user_spans(minutes: DataFrame) -> DataFrame:
    return minutes.groupBy(USER).agg(F.min(MINUTE).alias("first_minute"), F.max(MINUTE).alias("last_minute"))


def anchors(minutes: DataFrame, window: int = 1440, stride: int = 60) -> DataFrame:
    """Window ends per user: every ``stride`` from the first minute plus one window to the last minute."""
    start = F.col("first_minute") + window
    return (
        user_spans(minutes)
        .filter(start <= F.col("last_minute"))
        .select(USER, F.explode(F.sequence(start, F.col("last_minute"), F.lit(stride).cast("bigint"))).alias("anchor_relative_minute"))
    )


METRICS = ["hr", "steps", "intensity"]
SLOPES = ["hr", "steps"]


def _bucket_partials(minutes_a: DataFrame, stride: int) -> DataFrame:
    """Mergeable summaries per (user, stride bucket counted from the user's first minute).

    Rows of one minute are merged first, which also makes the distinct minute count a plain count.
    """
    x = F.col(MINUTE)
    night = 1 - F.col("is_day")
    parts: dict[str, Column] = {"rows": F.count(F.lit(1)), "active": F.sum("is_active_minute")}
    for m in METRICS:
        parts |= {
            f"{m}_n": F.count(m), f"{m}_s": F.sum(m), f"{m}_ss": F.sum(F.col(m).cast("double") * F.col(m).cast("double")),
            f"{m}_lo": F.min(m), f"{m}_hi": F.max(m),
        }
    for g in E.ACTIVITY_GROUPS:
        parts[f"g_{g}"] = F.sum((F.col("activity_group") == g).cast("int"))
    for part, flag in (("day", F.col("is_day")), ("night", night)):
        inside = flag == 1
        parts |= {
            f"{part}_rows": F.sum(flag), f"{part}_active": F.sum(flag * F.col("is_active_minute")),
            f"{part}_hr_n": F.count(F.when(inside, F.col("hr"))), f"{part}_hr_s": F.sum(F.when(inside, F.col("hr"))),
            f"{part}_steps_s": F.sum(F.when(inside, F.col("steps"))),
        }
    per_minute = minutes_a.groupBy(USER, MINUTE).agg(*[c.alias(n) for n, c in parts.items()])
    spans = user_spans(minutes_a)
    offset = F.pmod(x - F.col("first_minute"), F.lit(stride))
    placed = per_minute.join(spans, USER).withColumns(
        {"bucket": F.floor((x - F.col("first_minute")) / stride), "x": offset}
    )
    merged: list[Column] = [F.count(F.lit(1)).alias("minutes")]
    for n in parts:
        fold = F.min if n.endswith("_lo") else F.max if n.endswith("_hi") else F.sum
        merged.append(fold(n).alias(n))
    for m in SLOPES:
        n, s, at = F.col(f"{m}_n"), F.col(f"{m}_s"), F.col("x")
        merged += [F.sum(n * at).alias(f"{m}_x"), F.sum(n * at * at).alias(f"{m}_xx"), F.sum(s * at).alias(f"{m}_xy")]
    return placed.groupBy(USER, "first_minute", "last_minute", "bucket").agg(*merged)


def _to_anchors(df: DataFrame, window: int, stride: int) -> DataFrame:
    """Copy each bucket to the at most window/stride anchors whose window holds it."""
    n = window // stride
    last = F.floor((F.col("last_minute") - F.col("first_minute") - window) / stride)
    lo = F.greatest(F.col("bucket") - (n - 1), F.lit(0))
    hi = F.least(F.col("bucket"), last)
    return df.filter(lo <= hi).withColumn("k", F.explode(F.sequence(lo, hi)))


def _slide(buckets: DataFrame, spans: DataFrame, window: int, stride: int) -> DataFrame:
    """Add up the bucket summaries of every window: one row per (user, k), window k starting at bucket k.

    A user's buckets are cut into blocks; the few buckets that windows of the block before also need are
    copied to it. Every block is then a small sorted run with a sliding frame, so the cost is one shuffle of
    the summaries, whatever the overlap, and a user with a long history is still many tasks.
    """
    n = window // stride
    block = 8 * n
    at = F.col("bucket")
    first = F.greatest(F.floor((at - (n - 1)) / block), F.lit(0))
    held = buckets.withColumn("block", F.explode(F.sequence(first, F.floor(at / block))))
    shift = (at - F.col("block") * block) * stride
    moved = {}
    for m in SLOPES:
        rows, total, sx, sxx, sxy = (F.col(f"{m}_{p}") for p in ("n", "s", "x", "xx", "xy"))
        moved |= {
            f"{m}_x": sx + rows * shift,
            f"{m}_xx": sxx + 2 * shift * sx + rows * shift * shift,
            f"{m}_xy": sxy + total * shift,
        }
    last = F.floor((F.col("last_minute") - F.col("first_minute") - window) / stride)
    starts = (
        spans.filter(last >= 0)
        .select(USER, "first_minute", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("bucket"))
        .withColumns({"block": F.floor(at / block), "is_start": F.lit(True)})
    )
    both = held.withColumns(moved).drop("last_minute").unionByName(starts, allowMissingColumns=True)
    frame = WS.partitionBy(USER, "block").orderBy("bucket").rangeBetween(0, n - 1)
    keys = {USER, "first_minute", "bucket", "block", "is_start"}
    sums = []
    for c in (c for c in both.columns if c not in keys):
        fold = F.min if c.endswith("_lo") else F.max if c.endswith("_hi") else F.sum
        sums.append(fold(c).over(frame).alias(c))
    return both.select(USER, "first_minute", at.alias("k"), "is_start", *sums).filter("is_start").drop("is_start")


def sliding_window_features(
    minutes_a: DataFrame, window: int = 1440, stride: int = 60, min_coverage: float = 0.70
) -> DataFrame:
    """The 32 features of every sliding window with enough coverage.

    Windows are half-open and start a whole number of strides after the user's first minute, so each is
    exactly ``window/stride`` buckets. Buckets are summarised once and then added up per window, instead of
    copying every minute to every window.
    """
    if window % stride:
        raise ValueError("window must be a multiple of stride")
    slid = _slide(_bucket_partials(minutes_a, stride), user_spans(minutes_a), window, stride)
    sums = slid.filter(F.col("minutes") / window >= min_coverage)

    def mean(m: str) -> Column:
        return E.ratio(f"{m}_s", f"{m}_n")

    def std(m: str) -> Column:
        n, s, ss = F.col(f"{m}_n"), F.col(f"{m}_s"), F.col(f"{m}_ss")
        var = F.greatest((ss - s * s / F.when(n > 0, n)) / F.when(n > 1, n - 1), F.lit(0.0))
        return F.when(n > 1, F.when(F.col(f"{m}_lo") == F.col(f"{m}_hi"), 0.0).otherwise(F.sqrt(var)))

    def slope(m: str) -> Column:
        n, y, x, xx, xy = (F.col(f"{m}_{p}").cast("double") for p in ("n", "s", "x", "xx", "xy"))
        det = n * xx - x * x
        return F.when((n >= 2) & (det > 0), F.try_divide(n * xy - x * y, det))

    anchor = F.col("first_minute") + window + F.col("k") * stride
    out = sums.select(
        USER,
        anchor.alias("anchor_relative_minute"),
        (anchor - window).alias("window_start_minute"),
        anchor.alias("window_end_minute"),
        F.col("minutes").alias("observed_minutes"),
        (F.col("minutes") / window).alias("coverage"),
        F.col("rows").alias("n_rows_in_window"),
        mean("hr").alias("hr_mean"),
        std("hr").alias("hr_std"),
        F.col("hr_lo").alias("hr_min"),
        F.col("hr_hi").alias("hr_max"),
        (1 - F.col("hr_n") / window).alias("hr_missing_pct"),
        F.col("steps_s").alias("steps_sum"),
        mean("steps").alias("steps_mean"),
        F.col("steps_hi").alias("steps_max"),
        mean("intensity").alias("intensity_mean"),
        std("intensity").alias("intensity_std"),
        F.col("intensity_hi").alias("intensity_max"),
        E.ratio("active", "rows").alias("active_minute_frac"),
        *[E.ratio(f"g_{g}", "rows").alias(f"activity_frac_{g}") for g in E.ACTIVITY_GROUPS],
        E.ratio("day_hr_s", "day_hr_n").alias("day_hr_mean"),
        E.ratio("night_hr_s", "night_hr_n").alias("night_hr_mean"),
        F.col("day_steps_s").alias("day_steps_sum"),
        F.col("night_steps_s").alias("night_steps_sum"),
        E.ratio("day_active", "day_rows").alias("day_active_frac"),
        E.ratio("night_active", "night_rows").alias("night_active_frac"),
        slope("hr").alias("hr_slope"),
        slope("steps").alias("steps_slope"),
    )
    return out.join(_window_medians(minutes_a, window, stride), [USER, "anchor_relative_minute"], "left")


def _window_medians(minutes_a: DataFrame, window: int, stride: int) -> DataFrame:
    """Median heart rate per window, exact, by ranks over value counts.

    Readings are counted per bucket and value before anything is copied to windows, and ranks are taken over bands
    of values, so neither many rows nor many distinct values of one window meet in one task.
    """
    at = F.floor((F.col(MINUTE) - F.col("first_minute")) / stride).alias("bucket")
    counts = (
        minutes_a.filter(F.col("hr").isNotNull())
        .select(USER, MINUTE, "hr")
        .join(user_spans(minutes_a), USER)
        .groupBy(USER, "first_minute", "last_minute", at, "hr")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    anchor = (F.col("first_minute") + window + F.col("k") * stride).alias("anchor_relative_minute")
    spread = _to_anchors(counts, window, stride).select(USER, anchor, "hr", "n")
    return exact_quantiles(spread, [USER, "anchor_relative_minute"], "hr", {"hr_median": 0.5}, "n")


def numeric_columns(df: DataFrame, skip: Sequence[str] = (USER, DATE)) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if c not in skip and (t in kinds or t.startswith("decimal"))]


WINDOW_KEYS = [USER, "window_start_day", "window_end_day"]
STATS = ["sum", "mean", "std", "min", "max"]
BLOCK_WINDOWS = 8  # a block of days is this many of the longest window


def _laid_rows(windows: DataFrame, daily: dict[str, DataFrame], columns: dict[str, list[str]], carry: Sequence[str]) -> DataFrame:
    """All sources' daily rows and all windows as one table (user, day, source, length, values, carried columns).

    A daily row has its source's number and its values; a window has source -1, its last day, its length and what it carries.
    """
    length = (F.col("window_end_day") - F.col("window_start_day") + 1).cast("int")
    none = F.array().cast("array<double>")
    rows = windows.select(USER, F.col("window_end_day").cast("bigint").alias("day"), F.lit(-1).alias("source"), length.alias("length"), none.alias("values"), *carry)
    for k, (name, cols) in enumerate(columns.items()):
        values = F.array(*[F.col(c).cast("double") for c in cols]) if cols else none
        own = daily[name].select(USER, F.col(DATE).cast("bigint").alias("day"), F.lit(k).alias("source"), F.lit(0).alias("length"), values.alias("values"))
        rows = rows.unionByName(own, allowMissingColumns=True)
    return rows


PART_WINDOWS = 1024  # user blocks are put together until a group has about this many windows
TASK_PARTS = 16  # and a task about this many groups: what is shuffled is small, but laid out by sample it is some 400 MB of wide rows
STEP_VALUES = 2_000_000  # numbers of an array that a step of a group holds, 16 MB


def _block_stats(widths: Sequence[int], block: int, longest: int, carry: Sequence[str], decimals: tuple[int, float] | None):
    """The windows of some blocks of users' days, as a function of these blocks' rows as an Arrow table."""

    def stats(rows):
        import numpy as np
        import pyarrow as pa

        width, span = sum(widths), block + longest - 1
        day, source, length, of_block = (rows.column(c).to_numpy() for c in ("day", "source", "length", "block"))
        values = rows.column("values").combine_chunks()
        user = rows.column(USER).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        pair = user.astype(np.int64) * (of_block.max() - of_block.min() + 1) + of_block - of_block.min()
        is_window = source < 0
        asked, days = np.unique(pair[is_window]), np.flatnonzero(~is_window & np.isin(pair, pair[is_window]))
        pair = np.searchsorted(asked, pair)
        at = day - of_block * block + longest - 1  # a block has room for the longest window before its first day
        windows = np.flatnonzero(is_window)
        windows = windows[np.lexsort((length[windows], day[windows], pair[windows]))]
        days = days[np.argsort(pair[days], kind="stable")]
        out = np.full((len(windows), len(widths) + 5 * width), np.nan)
        some_pairs = max(1, STEP_VALUES // (span * max(1, width)))
        for low in range(0, len(asked), some_pairs):
            first, last = np.searchsorted(pair[windows], [low, low + some_pairs])
            mine = windows[first:last]
            held = days[slice(*np.searchsorted(pair[days], [low, low + some_pairs]))]
            # Days in a grid, block after block, NaN where nothing was seen.
            grid = np.full((min(some_pairs, len(asked) - low) * span, width), np.nan)
            seen = np.zeros((len(grid), len(widths)))
            for k, (begin, n) in enumerate(zip(np.cumsum([0, *widths]), widths)):
                own = held[source[held] == k]
                place = (pair[own] - low) * span + at[own]
                seen[place, k] = 1
                if n and len(own):
                    grid[place, begin : begin + n] = values.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            for n in np.unique(length[mine]):
                same = np.flatnonzero(length[mine] == n)
                for part in np.array_split(same, len(same) * int(n) * max(1, width) // STEP_VALUES + 1):
                    of = mine[part]
                    places = ((pair[of] - low) * span + at[of] - n + 1)[:, None] + np.arange(n)
                    out[first + part, : len(widths)] = seen[places].sum(1)
                    out[first + part, len(widths) :] = _folds(grid[places]).reshape(len(part), -1)
        if decimals:
            power, shifted = 10.0 ** decimals[0], out[:, len(widths) :] + decimals[1]
            whole = np.abs(shifted) < 2**52 / power  # beyond, a double has no room for these decimals
            out[:, len(widths) :] = np.where(whole, np.rint(np.where(whole, shifted, 0.0) * power) / power + 0.0, shifted)
        flat = pa.array(out.ravel(), from_pandas=True)  # NaN becomes NULL
        offsets = pa.array(np.arange(len(windows) + 1, dtype=np.int32) * out.shape[1])
        taken = rows.take(pa.array(windows))
        kept = {c: taken.column(c).cast(_nullable(taken.schema.field(c).type)) for c in carry}
        return pa.table({
            USER: taken.column(USER), "end": taken.column("day"), "length": taken.column("length"), **kept,
            "stats": pa.ListArray.from_arrays(offsets, flat),
        })

    return stats


def _nullable(kind):
    """The Arrow type as Spark reads it from a DDL text: nested fields may be null."""
    import pyarrow as pa

    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, _nullable(kind.value_type)))
    return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind]) if pa.types.is_struct(kind) else kind


def _folds(x):
    """Sum, mean, population std, min and max over the second axis of (windows, days, columns); NaN counts as missing."""
    import numpy as np

    held = ~np.isnan(x)
    count = held.sum(1)
    total = np.where(held, x, 0.0).sum(1)
    some = count > 0
    mean = np.divide(total, count, out=np.full(total.shape, np.nan), where=some)
    apart = np.where(held, x - mean[:, None, :], 0.0)
    spread = np.sqrt(np.divide((apart * apart).sum(1), count, out=np.full(total.shape, np.nan), where=some))
    low = np.where(some, np.where(held, x, np.inf).min(1), np.nan)
    high = np.where(some, np.where(held, x, -np.inf).max(1), np.nan)
    return np.stack([np.where(some, total, np.nan), mean, spread, low, high], 2)  # by column, then by statistic


def window_blocks(
    samples: DataFrame, daily: dict[str, DataFrame], zero_if_empty: Sequence[str] = (), carry: Sequence[str] = (), decimals: tuple[int, float] | None = None
) -> DataFrame:
    """Per distinct window the sum, mean, population std, min and max of every numeric column of every source, its
    days observed and its coverage. Sources in ``zero_if_empty`` have 0 where a window has no value, the others NULL.
    Columns named in ``carry`` go along with their window; then ``samples`` is taken as the windows, row by row. With
    ``decimals`` (digits, shift) the statistics are shifted and rounded where numpy holds them.

    One shuffle brings all sources' days and the windows of a block of days together; the days that windows of the
    next block reach back to are copied to it. No window is laid out by day, and a user with a long history is many
    small blocks. Blocks of several users are one group, dealt by their hash. Inside it numpy slides over the days of
    all columns at once: as window frames, which fold every column of every row anew for each length, the same took ten
    times as long. Each source has one row per (user, day); NaN counts as missing.
    """
    columns = {name: numeric_columns(table) for name, table in daily.items()}
    widths = [len(c) for c in columns.values()]
    windows = samples if carry else samples.select(*WINDOW_KEYS).distinct()
    longest, n = windows.agg(F.max(F.col("window_end_day") - F.col("window_start_day") + 1), F.count(F.lit(1))).first()
    longest = int(longest or 1)
    block = BLOCK_WINDOWS * longest
    rows = _laid_rows(windows, daily, columns, carry)
    # A window goes to the block of its last day, a daily row also to the block whose windows reach back to it.
    until = F.when(F.col("source") < 0, F.col("day")).otherwise(F.col("day") + longest - 1)
    held = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("day") / block), F.floor(until / block))))
    kinds = dict(samples.dtypes)
    held = held.withColumn(USER, F.col(USER).cast(kinds[USER]))
    parts = n // PART_WINDOWS + 1
    tasks = max(parts // TASK_PARTS, min(parts, samples.sparkSession.sparkContext.defaultParallelism))
    held = held.withColumn("part", F.pmod(F.xxhash64(USER, "block"), F.lit(parts))).repartition(tasks, "part")
    beside = "".join(f", `{c}` {kinds[c]}" for c in carry)
    found = held.groupBy("part").applyInArrow(_block_stats(widths, block, longest, carry, decimals), f"{USER} {kinds[USER]}, end bigint, length int{beside}, stats array<double>")
    at, out = len(widths), []
    for k, (name, cols) in enumerate(columns.items()):
        observed = F.get("stats", F.lit(k))
        out += [observed.alias(f"{name}_days_observed"), (observed / F.col("length")).alias(f"{name}_day_coverage")]
        for c in cols:
            for stat in STATS:
                value = F.get("stats", F.lit(at))
                out.append((F.coalesce(value, F.lit(0.0)) if name in zero_if_empty else value).alias(f"{c}_window_{stat}"))
                at += 1
    start = (F.col("end") - F.col("length") + 1).cast(kinds["window_start_day"])
    return found.select(USER, start.alias("window_start_day"), F.col("end").cast(kinds["window_end_day"]).alias("window_end_day"), *carry, *out)


def window_block(samples: DataFrame, daily: DataFrame, source: str, zero_if_empty: bool = False) -> DataFrame:
    """``window_blocks`` of one source."""
    return window_blocks(samples, {source: daily}, [source] if zero_if_empty else [])


def multimodal_block(
    labeled: DataFrame, inhaler: DataFrame, peakflow: DataFrame, weekly: DataFrame, static: DataFrame
) -> DataFrame:
    """Side information per 24-hour window: both daily sources on the day of the window's first minute, the
    latest earlier weekly symptoms, the static block; -1 for a missing value plus one flag per source.
    """
    from cohortlake.operators.timejoin import nearest_row
    from cohortlake.sources.schemas import SYMPTOM_COLUMNS

    out = labeled.withColumn("start_day", E.window_first_day("anchor_relative_minute"))
    base = [*labeled.columns, "start_day"]
    for flag, daily in (("smartinhaler_missing", inhaler), ("peakflow_missing", peakflow)):
        cols = numeric_columns(daily)
        joined = out.join(daily.withColumnRenamed(DATE, "start_day"), [USER, "start_day"], "left")
        out = joined.select(*out.columns, *fill_block(cols, flag))
    asked = weekly.select(USER, DATE, *[E.numeric(c).alias(c) for c in SYMPTOM_COLUMNS]).filter(F.col(USER).isNotNull())
    joined = nearest_row(out, asked, [USER], "start_day", DATE, SYMPTOM_COLUMNS, forward=False, per_column=True)
    out = joined.select(*out.columns, *fill_block(SYMPTOM_COLUMNS, "weekly_score_missing"))
    cols = [c for c in static.columns if c != USER]
    joined = out.join(static, USER, "left")
    done = [c for c in out.columns if c not in base]
    return joined.select(*base, *done, *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in cols])


def fill_block(cols: Sequence[str], flag: str) -> list[Column]:
    """-1 where missing, and a flag that is 1 only when the whole block is missing."""
    whole = F.coalesce(*[F.col(c).cast("double") for c in cols]).isNull()
    return [
        *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in cols],
        whole.cast("int").alias(flag),
    ]
