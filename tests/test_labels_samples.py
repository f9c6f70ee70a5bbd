import random

import pytest
from pyspark.sql import functions as F

from cohortlake.plans import labels as L, samples as P

WEEKLY = (
    "user_key int, date int, weekly_night_symp int, weekly_day_symp int, weekly_limit_activity int, weekly_short_breath int, "
    "weekly_wheeze int, weekly_relief_inhaler int, weekly_doc string, weekly_hospital string, weekly_er string, weekly_oral int"
)
DAILY = (
    "user_key int, date int, daily_night_symp string, daily_day_symp string, daily_limit_activity boolean, daily_prev_inhaler int, "
    "daily_relief_inhaler int, daily_triggers string"
)


def week(user, date, doc="0", hospital="0", er=None, oral=1, symptoms=(0, 0, 0, 0, 0, 0)):
    return (user, date, *symptoms, doc, hospital, er, oral)


def test_two_rules_for_hospital_and_oral(frame):
    rows = [week(1, 7, hospital="-1,-3"), week(1, 14, oral=3), week(1, 21, oral=4), week(1, 28, doc=" 0 "), week(1, 35, symptoms=(3, 4, 3, 0, 0, 0))]
    w = frame(rows, WEEKLY)
    first = {r["date"]: r["target_binary"] for r in L.weekly_targets(w).collect()}
    assert first == {7: 0, 14: 1, 21: 1, 28: 0, 35: 1}
    later = {r["date"]: r["broad_event_week"] for r in L.weekly_events(w).collect()}
    assert later == {7: True, 14: True, 21: False, 28: False, 35: False}


def test_empty_covered_week_and_missing_columns(frame):
    out = L.weekly_events(frame([week(1, 0, doc="-1")], WEEKLY)).first()
    assert (out["week_start_day"], out["week_end_day"], out["has_valid_covered_days"]) == (0, -1, False)
    with pytest.raises(KeyError):
        L.weekly_events(frame([(1, 0)], "user_key int, date int"))


def test_label_windows_strict_and_within_horizon(frame):
    targets = L.weekly_targets(frame([week(1, 7), week(1, 9, doc="-1"), week(3, 40)], WEEKLY))
    due = 8 * 1440
    windows = frame([(1, due - 1), (1, due), (1, due - 7 * 1440 - 1), (1, due - 7 * 1440), (2, due), (1, 99999)], "user_key int, anchor_relative_minute bigint")
    out = {(r["user_key"], r["anchor_relative_minute"]): (r["questionnaire_day"], r["target_binary"]) for r in L.label_windows(windows, targets).collect()}
    assert out == {(1, due - 1): (8, 0), (1, due): (10, 1), (1, due - 7 * 1440): (8, 0)}


def test_onset_labels_drop_unknown_horizons(frame):
    windows = frame([(1, 1440 * d) for d in range(1, 15)] + [(2, 1440 * d) for d in range(1, 10)], "user_key int, anchor_relative_minute bigint")
    days = frame([(1, 5)], "user_key int, event_day int")
    out = L.label_windows_by_onset(windows, days, 7).collect()
    got = {(r["user_key"], r["end_day"]): (r["target_binary"], r["time_to_event_days"]) for r in out}
    assert got == {**{(1, d): (1, 5 - d) for d in range(5)}, (1, 5): (0, None), (1, 6): (0, None), (2, 0): (0, None), (2, 1): (0, None)}
    none = L.label_windows_by_onset(windows, frame([], "user_key int, event_day int"), 7)
    assert none.count() == 23 and none.agg(F.sum("target_binary")).first()[0] == 0


def test_scores_and_episodes(frame):
    weekly = frame([week(1, 7, doc="-1,-2", hospital="-2"), week(2, 7, doc="-9")], WEEKLY)
    daily = [
        (1, 3, "true", "True", True, 4, 9, "5,9"), (1, 3, "true", "True", True, 4, 9, "5,9"), (1, 4, None, "false", False, 1, 5, "5"),
        (1, 8, "true", "true", True, 4, 12, "2"), (2, 3, "true", "true", True, 4, 12, "2"),
    ]
    t = L.build_labels(weekly, frame(daily, DAILY))
    scores = {(r["user_key"], r["date"]): r[L.SCORE] for r in t.daily_scores.collect()}
    assert scores == {(1, 3): 8, (1, 4): 2}
    days = {(r["threshold"], r["event_day"]): (r["event_day_source"], r["event_day_confidence"]) for r in t.probable_days.collect()}
    named = {5: ("weekly_doc+weekly_hospital", "high"), 6: ("weekly_doc", "high"), 3: ("daily_score", "probable")}
    assert days == {**{(k, d): v for k in (2, 3, 4) for d, v in named.items()}, (2, 4): ("daily_score", "probable")}
    runs = sorted((r["threshold"], r["episode_id"], r["event_onset_day"], r["event_end_day"], r["event_day_sources"]) for r in t.episodes.collect())
    both = "weekly_doc+weekly_hospital"
    assert runs == [(2, 1, 3, 6, f"daily_score+{both}"), (3, 1, 3, 3, "daily_score"), (3, 2, 5, 6, both), (4, 1, 3, 3, "daily_score"), (4, 2, 5, 6, both)]


def test_one_daily_row_in_two_overlapping_weeks(frame):
    weekly = frame([week(1, 7, doc="-1"), week(1, 9, doc="-1")], WEEKLY)
    out = L.scores_in_positive_weeks(L.daily_scores(frame([(1, 4, None, None, None, 1, 0, None)], DAILY)), L.weekly_events(weekly))
    assert sorted(r["weekly_date"] for r in out.collect()) == [7, 9]


def brute_samples(events, days, runs, T, Ls, Ws):
    """Day-by-day sets, as plain Python."""
    pos, neg = set(), set()
    for e in events:
        if e["has_valid_covered_days"]:
            (pos if e["broad_event_week"] else neg).update((e["user_key"], d) for d in range(e["week_start_day"], e["week_end_day"] + 1))
    kept, reasons = set(), {}
    for t in T:
        hot = {(d["user_key"], d["event_day"]) for d in days if d["threshold"] == t}
        spans = [(r["user_key"], r["event_onset_day"], r["event_end_day"]) for r in runs if r["threshold"] == t]
        for n in Ls:
            for w in Ws:
                washed = {(u, d) for u, _, e in spans for d in range(e + 1, e + w + 1)}
                for u, a, _ in spans:
                    if a - n >= 0:
                        kept.add((1, t, n, w, u, a))
                for u, a in neg - pos:
                    if a - n < 0:
                        continue
                    inside = {(u, d) for d in range(a - n, a + 1)}
                    hit = any(su == u and not (a - 1 < s or a - n > e) for su, s, e in spans)
                    reason = "positive_week_overlap" if inside & pos else "event_overlap" if inside & hot or hit else "washout" if inside & washed else None
                    if reason:
                        reasons[(t, n, w, reason)] = reasons.get((t, n, w, reason), 0) + 1
                    else:
                        kept.add((0, t, n, w, u, a))
    return kept, reasons


def test_sample_grid_matches_day_sets(spark, frame):
    rng = random.Random(5)
    events, days = [], []
    for u in (1, 2, 3):
        for k in range(1, 12):
            d = 7 * k + rng.randint(0, 1)
            events.append((u, d, rng.random() < 0.25, max(d - 7, 0), d - 1, True))
        days += [(u, t, d, "probable", "daily_score") for t in (2, 3) for d in rng.sample(range(80), 7)]
    ev = frame(events, "user_key int, date int, broad_event_week boolean, week_start_day int, week_end_day int, has_valid_covered_days boolean")
    pr = frame(days, "user_key int, threshold int, event_day int, event_day_confidence string, event_day_source string")
    runs = L.episodes(pr)
    T, Ls, Ws = (2, 3), (3, 7), (0, 5)
    samples, counts = P.build_samples(ev, pr, runs, T, Ls, Ws)
    want, reasons = brute_samples(ev.collect(), pr.collect(), runs.collect(), T, Ls, Ws)
    got = {(r["target"], r["threshold"], r["input_length_days"], r["washout_days"], r["user_key"], r["sample_anchor_day"]) for r in samples.collect()}
    assert got == want and samples.count() == len(want)
    for r in counts.collect():
        key = (r["threshold"], r["input_length_days"], r["washout_days"])
        for name in P.REASONS:
            assert r[f"negative_excluded_{name}"] == reasons.get((*key, name), 0)
        assert r["negative_candidates"] == r["negative_samples"] + r["negative_excluded_total"]
        assert r["positive_candidates"] == r["positive_samples"] + r["positive_excluded_not_enough_history"]
    assert any(r[3] == "event_overlap" for r in reasons) and any(r[3] == "washout" for r in reasons)
    P.verify_samples(samples, ev, pr, runs)
    broken = samples.withColumn("window_end_day", F.when(F.col("target") == 1, F.col("window_end_day") + 1).otherwise(F.col("window_end_day")))
    with pytest.raises(AssertionError):
        P.verify_samples(broken, ev, pr, runs)


def test_empty_cells_are_counted(frame):
    ev = frame([(1, 7, True, 0, 6, True)], "user_key int, date int, broad_event_week boolean, week_start_day int, week_end_day int, has_valid_covered_days boolean")
    pr = frame([], "user_key int, threshold int, event_day int, event_day_confidence string, event_day_source string")
    samples, counts = P.build_samples(ev, pr, L.episodes(pr), (2,), (7,), (0, 7))
    assert samples.count() == 0 and [r["total_samples"] for r in counts.collect()] == [0, 0]


def test_contract_check_lays_out_no_window(spark, frame):
    index = frame(
        [(1, 20, 6, 19, None, None, 0, 2, 14, 7), (1, 20, 6, 19, None, None, 0, 2, 14, 7), (1, 40, 33, 39, None, None, 0, 2, 7, 7),
         (2, 20, 6, 19, None, None, 0, 2, 14, 7), (3, 9, 2, 8, None, None, 0, 3, 7, 0), (4, 30, 22, 28, 30, 31, 1, 2, 7, 0)],
        "user_key INT, sample_anchor_day INT, window_start_day INT, window_end_day INT, event_onset_day INT, event_end_day INT, "
        "target INT, threshold INT, input_length_days INT, washout_days INT",
    )
    weeks = frame([(2, 0, 6, True, True), (3, 10, 16, True, True)],
                  "user_key INT, week_start_day INT, week_end_day INT, has_valid_covered_days BOOLEAN, broad_event_week BOOLEAN")
    probable = frame([(1, 20, 2), (1, 32, 2), (3, 5, 2), (3, 10, 3)], "user_key INT, event_day INT, threshold INT")
    runs = frame([(1, 2, 26), (2, 2, 21)], "user_key INT, threshold INT, event_end_day INT")
    bad = P.contract_violations(index, weeks, probable, runs)
    assert sorted((r["user_key"], r["sample_anchor_day"], r["rule"]) for r in bad.collect()) == [
        (1, 20, "event_day"), (1, 40, "washout_day"), (2, 20, "positive_week_day"), (4, 30, "positive_window_end"),
    ]
    plan = P.contract_violations(index, weeks, probable, runs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") <= 2  # the weeks' days and the washout days
