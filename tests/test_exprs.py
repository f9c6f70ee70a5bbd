import pytest
from pyspark.sql import functions as F

from cohortlake.functions import exprs as E


def one(frame, value, ddl, expr):
    return frame([(value,)], f"c {ddl}").select(expr("c").alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text,expected",
    [("-1,-3", [-1, -3]), ("0", []), ("-7", [-7]), ("-9", []), ("x", []), (None, []), (" -2 , 0.0,nan", [-2]), ("-7.5", [-7]), ("-0.5", [])],
)
def test_week_offsets(frame, text, expected):
    assert one(frame, text, "string", E.week_offsets) == expected
    assert one(frame, text, "string", E.has_week_offset) is bool(expected)


@pytest.mark.parametrize("text,expected", [("5,9", True), ("5", False), (" 2 ", True), (None, False), ("", False), ("22", False), ("1, 14", True)])
def test_triggers(frame, text, expected):
    assert one(frame, text, "string", E.has_trigger) is expected


@pytest.mark.parametrize("value,expected", [(0, 0), (1, 1), (3, 1), (5, 2), (9, 3), (12, 3), (7, 0), (None, 0)])
def test_relief_points(frame, value, expected):
    assert one(frame, value, "int", E.relief_points) == expected


@pytest.mark.parametrize("text,expected", [("00:00:59", 0), ("23:59:00", 1439), ("25:00:00", None), (None, None), ("bad", None)])
def test_minute_of_day(frame, text, expected):
    assert one(frame, text, "string", E.minute_of_day) == expected


@pytest.mark.parametrize("code,expected", [(1.0, "walk"), (17.0, "activity_high"), (106.0, "sleep"), (3.0, "not_worn"), (6.0, "charging"), (999.0, "unknown"), (None, "unknown")])
def test_activity_group(frame, code, expected):
    assert one(frame, code, "double", E.activity_group) == expected


@pytest.mark.parametrize("text,expected", [("Very High", 4), ("LOW", 1), ("none", None), (None, None)])
def test_pollen(frame, text, expected):
    assert one(frame, text, "string", E.pollen_level) == expected


def test_numbers(frame):
    df = frame([("1.5",), ("NaN",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(E.numeric("c")).collect()] == [1.5, None, None, None]
    nums = frame([(float("nan"),), (float("-inf"),), (2.0,), (None,)], "c double")
    assert [r[0] for r in nums.select(E.finite_or_zero("c")).collect()] == [0.0, 0.0, 2.0, 0.0]
    assert [r[0] for r in nums.select(E.clip(F.nanvl("c", F.lit(5.0)), 0.0, 3.0)).collect()] == [3.0, 0.0, 2.0, None]


def test_window_days_floor_not_truncate(frame):
    df = frame([(1440,), (1439,), (100,)], "a bigint")
    assert [r[0] for r in df.select(E.window_end_day("a")).collect()] == [0, -1, -1]
    assert [r[0] for r in df.select(E.window_first_day("a")).collect()] == [0, -1, -1]


def test_texts(frame):
    row = frame([(None, 0.25, 7)], "a double, b double, c int").select(
        E.report_number("a").alias("x"), E.mean_pm_std("b", "a").alias("y"), E.report_int("c").alias("z")
    ).first()
    assert tuple(row) == ("---", "0.250 +/- 0.000", "7")


def test_day_span_of_empty_interval(frame):
    assert one(frame, 3, "int", lambda c: E.day_span(c, F.lit(2))) == []
