import random

import pytest

from cohortlake.operators.timejoin import count_overlaps, nearest_row, rows_in_intervals


def brute(left, right, forward, strict):
    out = []
    for user, t in left:
        if forward:
            hits = [(rt, p) for u, rt, p in right if u == user and (rt > t or (not strict and rt == t))]
            out.append((user, t, min(hits)[1] if hits else None))
        else:
            hits = [(rt, p) for u, rt, p in right if u == user and (rt < t or (not strict and rt == t))]
            out.append((user, t, max(hits, key=lambda h: (h[0], -h[1]))[1] if hits else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("bucket", [None, 10])
def test_nearest_row(spark, forward, strict, bucket):
    rng = random.Random(3)
    left = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(-20, 120)) for _ in range(200)]
    right = list({(u, rng.randint(-20, 120)): 0 for u in (1, 1, 1, 2, 4) for _ in range(12)})
    right = [(u, t, i) for i, (u, t) in enumerate(right)]
    got = nearest_row(
        spark.createDataFrame(left, "u int, t bigint"), spark.createDataFrame(right, "u int, rt int, p int"),
        ["u"], "t", "rt", ["p"], forward=forward, strict=strict, bucket=bucket,
    )
    assert sorted(map(tuple, got.collect()), key=repr) == brute(left, right, forward, strict)


def test_strict_match_skips_equal_time(frame):
    left, right = frame([(1, 10)], "u int, t int"), frame([(1, 10, "same"), (1, 11, "later")], "u int, rt int, p string")
    assert nearest_row(left, right, ["u"], "t", "rt", ["p"], forward=True).first()["p"] == "later"
    assert nearest_row(left, right, ["u"], "t", "rt", ["p"], forward=True, strict=False).first()["p"] == "same"


@pytest.mark.parametrize("bucket", [None, 2])
def test_last_non_null_per_column(frame, bucket):
    left = frame([(1, 5), (1, 1), (2, 5)], "u int, t int")
    right = frame([(1, 1, 7, None), (1, 3, None, 8), (1, 5, 9, 9)], "u int, d int, a int, b int")
    out = nearest_row(left, right, ["u"], "t", "d", ["a", "b"], forward=False, per_column=True, bucket=bucket)
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, 1, None, None), (1, 5, 7, 8), (2, 5, None, None)]


def test_empty_right_side(spark, frame):
    left = frame([(1, 5)], "u int, t int")
    right = frame([], "u int, rt int, p int")
    assert tuple(nearest_row(left, right, ["u"], "t", "rt", ["p"], forward=True, bucket=4).first()) == (1, 5, None)


def test_row_in_two_intervals_comes_twice(frame):
    rows = frame([(1, 5), (1, 9), (2, 5)], "u int, day int")
    spans = frame([(1, 3, 5, "a"), (1, 5, 6, "b"), (1, 8, 7, "empty")], "u int, s int, e int, w string")
    out = rows_in_intervals(rows, spans, ["u"], "day", "s", "e")
    assert sorted((r["u"], r["day"], r["w"]) for r in out.collect()) == [(1, 5, "a"), (1, 5, "b")]


def test_overlaps_are_counted_without_days(frame):
    rng = random.Random(3)
    windows = [(rng.choice([1, 2, None]), t, a, a + rng.randrange(-1, 9)) for t in (2, 3) for a in range(60)] + [(1, 2, 0, 2_000_000_000), (1, 2, None, 5)]
    spans = [(rng.choice([1, 2, None]), t, a, a + rng.randrange(-1, 5)) for t in (2, 3) for a in range(0, 60, 4)] * 2 + [(1, 2, 3, 2_000_000_000), (1, 2, None, 4), (1, 2, 4, None)]
    got = count_overlaps(
        frame(windows, "user_key bigint, threshold int, lo int, hi int"), frame(spans, "user_key bigint, threshold int, onset int, end int"),
        ["user_key", "threshold"], ("lo", "hi"), ("onset", "end"), "hits",
    )
    want = []
    for u, t, lo, hi in windows:
        n = sum(u is not None and (u, t) == s[:2] and None not in (*s, lo) and s[2] <= s[3] and lo <= hi and s[2] <= hi and s[3] >= lo for s in spans)
        want += [(u, t, lo, hi, n)] * (n > 0)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 40
