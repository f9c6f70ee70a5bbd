"""Column expressions: casts, guards, encodings and small parsers.

Everything here is a pure function of columns, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F

# Fixed values (must equal the source study's coding).
DAY_MINUTES = 1440
TIME_PATTERN = "^([01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]$"
DAY_START_MINUTE = 360
DAY_END_MINUTE = 1320
ACTIVITY_CODES = {
    "walk": [1, 16, 33],
    "running": [66, 82, 98],
    "activity_high": [17],
    "sedentary": [80, 89, 90, 91, 92, 96],
    "sleep": [106, 112, 121, 122, 123],
    "not_worn": [3],
    "charging": [6],
}
ACTIVITY_GROUPS = ["walk", "running", "activity_high", "sedentary", "sleep", "not_worn", "charging", "unknown"]
ACTIVE_GROUPS = ["walk", "running", "activity_high"]
POLLEN_LEVELS = {"low": 1, "moderate": 2, "high": 3, "very high": 4}
TRIGGER_CODES = ["2", "9", "11", "12", "13", "14"]
SYMPTOM_CUTOFFS = {
    "weekly_day_symp": 4,
    "weekly_night_symp": 3,
    "weekly_short_breath": 4,
    "weekly_wheeze": 4,
    "weekly_relief_inhaler": 4,
    "weekly_limit_activity": 3,
}
RELIEF_POINTS = {0: 0, 1: 1, 3: 1, 5: 2, 9: 3, 12: 3}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric(c: str | Column) -> Column:
    """Lenient cast: text that is not a number becomes NULL, and so does NaN."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def finite_or_zero(c: str | Column) -> Column:
    """NULL, NaN and infinities become 0."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))


def clip(c: str | Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Clip to bounds, keeping NULL (least and greatest alone would skip it)."""
    x = out = col(c)
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(x.isNotNull(), out)


def ratio(num: str | Column, den: str | Column) -> Column:
    """Division with NULL instead of an error on a zero denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def any_flag(*cols: str | Column) -> Column:
    return reduce(or_, [F.coalesce(col(c), F.lit(False)) for c in cols])


def at_least_k(cutoffs: dict[str, float], k: int) -> Column:
    """True when at least ``k`` of the columns reach their own cut-off; NULL counts as 0."""
    hits = [(F.coalesce(numeric(c), F.lit(0.0)) >= cut).cast("int") for c, cut in cutoffs.items()]
    return reduce(add, hits) >= k


def text_true(c: str | Column) -> Column:
    """Boolean from text or boolean: 'true' in any case is true, NULL is false."""
    return F.coalesce(F.lower(col(c).cast("string")) == "true", F.lit(False))


def text_not_zero(c: str | Column) -> Column:
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("0"))) != "0"


def week_offsets(c: str | Column) -> Column:
    """Comma list such as '-1,-3' to the whole-day offsets that lie in -7..-1; junk is skipped."""
    parts = F.split(F.coalesce(col(c).cast("string"), F.lit("")), ",")
    nums = F.transform(parts, lambda x: F.trim(x).try_cast("double"))
    kept = F.filter(nums, lambda x: x.isNotNull() & ~F.isnan(x) & (x > -8) & (x <= -1))
    return F.transform(kept, lambda x: x.cast("int"))


def has_week_offset(c: str | Column) -> Column:
    return F.size(week_offsets(c)) > 0


def has_trigger(c: str | Column) -> Column:
    codes = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: F.trim(x))
    return F.arrays_overlap(codes, F.array(*[F.lit(t) for t in TRIGGER_CODES]))


def lookup(c: Column, table: dict, default=None) -> Column:
    """Small constant map as one CASE."""
    out = None
    for key, value in table.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out if default is None else out.otherwise(default)


def pollen_level(c: str | Column) -> Column:
    return lookup(F.lower(col(c)), POLLEN_LEVELS)


def relief_points(c: str | Column) -> Column:
    return lookup(numeric(c), RELIEF_POINTS, 0)


def activity_group(c: str | Column) -> Column:
    x = numeric(c)
    out = None
    for name, codes in ACTIVITY_CODES.items():
        hit = x.isin([float(v) for v in codes])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def is_time(c: str | Column) -> Column:
    return col(c).rlike(TIME_PATTERN)


def minute_of_day(c: str | Column) -> Column:
    """'HH:MM:SS' to minutes after midnight, NULL for a bad time.

    A pattern test and two casts: several times cheaper per row than a timestamp parser.
    """
    hour = F.substring_index(col(c), ":", 1)
    minute = F.substring_index(F.substring_index(col(c), ":", 2), ":", -1)
    return F.when(is_time(c), hour.cast("bigint") * 60 + minute.cast("bigint"))


def is_daytime(c: str | Column) -> Column:
    return (col(c) >= DAY_START_MINUTE) & (col(c) < DAY_END_MINUTE)


def window_end_day(anchor: str | Column) -> Column:
    """Last whole day before the anchor minute."""
    return (F.floor(col(anchor) / DAY_MINUTES) - 1).cast("int")


def window_first_day(anchor: str | Column, window_minutes: int = DAY_MINUTES) -> Column:
    return F.floor((col(anchor) - window_minutes) / DAY_MINUTES).cast("int")


def day_span(start: str | Column, end: str | Column) -> Column:
    """Array of days start..end, empty when the interval is empty."""
    return F.when(col(start) <= col(end), F.sequence(col(start), col(end))).otherwise(
        F.array().cast("array<int>")
    )


def param_key(params: Column) -> Column:
    """Map of parameters to a sorted 'k=v;k=v' text."""
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(pairs, ";")


def plus_join(sets: Column) -> Column:
    """Sorted distinct values joined by '+'."""
    return F.array_join(F.array_sort(F.array_distinct(sets)), "+")


def report_number(c: str | Column, digits: int = 3) -> Column:
    return F.when(col(c).isNotNull(), F.format_string(f"%.{digits}f", col(c))).otherwise("---")


def report_int(c: str | Column) -> Column:
    return F.when(col(c).isNotNull(), F.format_string("%d", col(c).cast("bigint"))).otherwise("---")


def mean_pm_std(mean: str | Column, std: str | Column, digits: int = 3) -> Column:
    spread = F.format_string(f"%.{digits}f", F.coalesce(col(std), F.lit(0.0)))
    return F.concat(report_number(mean, digits), F.lit(" +/- "), spread)


def hash_order(seed: int | str, *keys: str | Column) -> Column:
    """Seeded pseudo-random text order, the same on every engine that has MD5."""
    parts = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit(":"), col(k).cast("string")]
    return F.md5(F.concat(*parts))


def hash_index(seed: int | str, size: Column, *keys: str | Column) -> Column:
    """Seeded pseudo-random index in 0..size-1, from 60 bits: even for any size that rows can have."""
    head = F.substring(hash_order(seed, *keys), 1, 15)
    return F.conv(head, 16, 10).cast("bigint") % size
