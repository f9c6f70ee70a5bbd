import math
import random

import numpy as np
import pandas as pd
import pytest

from cohortlake.operators import daily as D, windows as W

RAW = "user_key int, date int, time string, activity_type double, intensity double, steps double, hr double"


def test_clean_minutes(frame):
    rows = [
        (1, 0, "00:10:00", 1.0, 2.0, -1.0, 0.0), (1, 0, "00:10:00", 1.0, 2.0, -1.0, 0.0), (1, 0, "00:10:30", 1.0, 2.0, 0.0, -5.0),
        (1, -1, "00:10:00", 1.0, 2.0, 3.0, 70.0), (1, 1, "25:00:00", 1.0, 2.0, 3.0, 70.0), (1, 1, None, 1.0, 2.0, 3.0, 70.0),
        (2, 2, "01:00:00", 999.0, None, 4.0, None),
    ]
    out = D.clean_minutes(frame(rows, RAW)).orderBy("user_key", "time").collect()
    assert [(r["user_key"], r["relative_minute"], r["steps"], r["hr"]) for r in out] == [(1, 10, None, None), (1, 10, 0.0, None), (2, 2940, 4.0, None)]


def test_day_with_no_night_rows_stays_null_and_null_sums_are_zero(frame):
    rows = [(1, 0, "10:00:00", 1.0, 2.0, None, 60.0), (1, 0, "10:01:00", 3.0, 2.0, None, 80.0)]
    out = D.smartwatch_daily(D.add_activity(D.clean_minutes(frame(rows, RAW)))).first()
    assert out["smartwatch_steps_sum"] == 0.0 and out["smartwatch_day_steps_sum"] == 0.0
    assert out["smartwatch_night_steps_sum"] is None and out["smartwatch_night_hr_mean"] is None
    assert out["smartwatch_hr_median"] == 70.0 and out["smartwatch_active_minute_frac"] == 0.5


def test_inhaler_hours_and_names(frame):
    rows = [(1, 0, h, n) for h, n in [(-1, "a"), (24, "a"), (0, "a"), (5, None), (6, "b"), (18, "a"), (23, "a")]] + [(1, -3, 4, "a")]
    out = D.inhaler_daily(frame(rows, "user_key int, date int, hour int, name string")).collect()
    assert [tuple(r) for r in out] == [(1, 0, 5, 2, 2, 2, 1)]


def test_peakflow_baseline_and_morning(frame):
    pf = [(1, 0, 8, 300.0, True), (1, 0, 9, 200.0, None), (1, 0, 20, 400.0, False), (1, 0, 20, 0.0, False), (9, 0, 8, 100.0, False)]
    patient = frame([(1, None, 500.0)], "user_key int, pef_best double, max_pef_expected double")
    out = {r["user_key"]: r for r in D.peakflow_daily(frame(pf, "user_key int, date int, hour int, pef_max double, morning boolean"), patient).collect()}
    assert out[1]["peakflow_pct_baseline_mean"] == pytest.approx(0.6)
    assert (out[1]["peakflow_morning_count"], out[1]["peakflow_evening_count"]) == (2, 1)
    assert out[9]["peakflow_pct_baseline_mean"] is None and out[9]["peakflow_morning_count"] is None


def test_one_hot_with_null_and_duplicate_user(frame):
    patient = frame([(1, "m", 3.0), (1, "m", 3.0), (2, None, None)], "user_key int, sex string, pef_best double")
    out = {r["user_key"]: r.asDict() for r in D.patient_static(patient).collect()}
    assert out[1] == {"user_key": 1, "patient_pef_best": 3.0, "patient_sex_m": 1, "patient_sex_nan": 0}
    assert out[2] == {"user_key": 2, "patient_pef_best": None, "patient_sex_m": 0, "patient_sex_nan": 1}


def minute_rows(seed=0):
    rng = random.Random(seed)
    rows = []
    for user, start, n in ((1, 5, 3100), (2, 7, 900), (3, 0, 2900)):
        for m in range(start, start + n):
            if rng.random() < 0.15 or (user == 3 and 400 < m < 1100):
                continue
            at = (m // 1440, f"{m % 1440 // 60:02d}:{m % 60:02d}:00")
            hr = 66.0 if user == 3 else round(rng.uniform(50, 120), 1)
            rows.append((user, *at, float(rng.choice([1, 3, 17, 90, 106, 999])), rng.random(), float(rng.randint(-1, 9)), None if rng.random() < 0.2 else hr))
            if rng.random() < 0.05:
                rows.append((user, *at, 1.0, rng.random(), 3.0, hr + 1))
    return rows


@pytest.mark.parametrize("window,stride,coverage", [(1440, 60, 0.70), (720, 240, 0.0)])
def test_sliding_features_match_brute_force(frame, window, stride, coverage):
    minutes = D.add_activity(D.clean_minutes(frame(minute_rows(), RAW)))
    got = W.sliding_window_features(minutes, window, stride, coverage).toPandas().set_index(["user_key", "anchor_relative_minute"]).sort_index()
    pdf = minutes.toPandas()
    want = {}
    for user, g in pdf.groupby("user_key"):
        lo, hi = g["relative_minute"].min(), g["relative_minute"].max()
        for anchor in range(lo + window, hi + 1, stride):
            w = g[(g["relative_minute"] >= anchor - window) & (g["relative_minute"] < anchor)]
            seen = w["relative_minute"].nunique()
            if len(w) == 0 or seen / window < coverage:
                continue
            x = (w["relative_minute"] - w["relative_minute"].min()).to_numpy(float)
            ok = w["hr"].notna().to_numpy()
            slope = np.polyfit(x[ok], w["hr"].to_numpy()[ok], 1)[0] if ok.sum() > 1 and np.ptp(x[ok]) > 0 else np.nan
            night = w[w["is_day"] == 0]
            want[(user, anchor)] = {
                "observed_minutes": seen, "n_rows_in_window": len(w), "hr_mean": w["hr"].mean(), "hr_std": w["hr"].std(),
                "hr_median": w["hr"].median(), "hr_missing_pct": 1 - w["hr"].notna().sum() / window, "steps_sum": w["steps"].sum(),
                "intensity_std": w["intensity"].std(), "activity_frac_walk": (w["activity_group"] == "walk").mean(),
                "night_steps_sum": night["steps"].sum(min_count=1), "night_active_frac": night["is_active_minute"].mean() if len(night) else np.nan,
                "hr_slope": slope,
            }
    want = pd.DataFrame.from_dict(want, orient="index").sort_index()
    assert list(got.index) == list(want.index) and len(want) > 5
    for c in want.columns:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-7, atol=1e-9, err_msg=c)


def test_window_block(frame):
    samples = frame([(1, 0, 6), (1, 0, 6), (2, 0, 6)], "user_key int, window_start_day int, window_end_day int")
    daily = frame([(1, 0, 2.0, None), (1, 6, 4.0, None), (1, 7, 100.0, 1.0)], "user_key int, date int, a double, b double")
    out = {r["user_key"]: r for r in W.window_block(samples, daily, "src").collect()}
    assert out[1]["src_days_observed"] == 2.0 and math.isclose(out[1]["src_day_coverage"], 2 / 7)
    assert out[1]["a_window_std"] == 1.0 and out[1]["b_window_sum"] is None and out[2]["a_window_mean"] is None
    zero = {r["user_key"]: r for r in W.window_block(samples, daily, "src", True).collect()}
    assert zero[2]["a_window_max"] == 0.0 and zero[1]["b_window_sum"] == 0.0 and zero[2]["src_days_observed"] == 0.0


def test_medians_of_crowded_windows_and_nan_readings(frame):
    import statistics

    rng = random.Random(5)
    rows = [(1, m // 1440, f"{m % 1440 // 60:02d}:{m % 60:02d}:00", 1.0, 0.5, 1.0, float("nan") if m % 7 == 0 else rng.uniform(50, 150)) for m in range(3000) for _ in range(4)]
    minutes = D.add_activity(D.clean_minutes(frame(rows, RAW)))
    got = {r["anchor_relative_minute"]: r["hr_median"] for r in W._window_medians(minutes, 720, 240).collect()}
    kept = [(r["relative_minute"], r["hr"]) for r in minutes.select("relative_minute", "hr").collect() if r["hr"] is not None]
    assert len(got) > 5 and all(h == h for _, h in kept)
    for anchor, median in got.items():
        assert abs(statistics.median(h for m, h in kept if anchor - 720 <= m < anchor) - median) < 1e-9


def test_any_number_of_categories(frame):
    rows = [(u, f"v{u % 450:03d}" if u % 11 else None, "m" if u % 2 else None) for u in range(1000)]
    patient = frame(rows, "user_key int, region string, sex string")
    vectors, dimension = D.category_vectors(patient)
    index = {(r["column"], r["value"]): r["index"] for r in dimension.collect()}
    order = sorted(index, key=lambda k: (k[0], k[1] is None, k[1] or ""))
    assert [index[k] for k in order] == list(range(len(order))) and len(order) == 453
    got = {r["user_key"]: r["indices"] for r in vectors.collect()}
    assert got == {u: sorted([index["region", v], index["sex", s]]) for u, v, s in rows}
    wide = D.patient_static(patient, {"region": ["v001", "v002"]}).columns
    assert [c for c in wide if c.startswith("patient_region")] == ["patient_region_v001", "patient_region_v002", "patient_region_nan"]



def brute_blocks(windows, tables):
    out = {}
    for u, a, b in set(windows):
        row = {}
        for name, (cols, rows) in tables.items():
            held = [r for r in rows if r[0] == u and a <= r[1] <= b]
            row[f"{name}_days_observed"] = float(len(held))
            row[f"{name}_day_coverage"] = len(held) / (b - a + 1)
            for k, c in enumerate(cols):
                v = [r[2 + k] for r in held if r[2 + k] is not None]
                zero = 0.0 if name == "z" else None
                row |= {f"{c}_window_{s}": zero for s in W.STATS}
                if v:
                    row |= dict(zip((f"{c}_window_{s}" for s in W.STATS), (sum(v), np.mean(v), np.std(v), min(v), max(v))))
        out[u, a, b] = row
    return out


def test_window_blocks_of_several_sources_slide_over_blocks(frame, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(W, "BLOCK_WINDOWS", 2)  # many block edges
    windows = [(u, e - n + 1, e) for u in (1, 2, 3, 9) for e in range(-20, 120, 3) for n in (1, 4, 9) if rng.random() < 0.8]
    some = lambda: None if rng.random() < 0.3 else rng.choice([1e9 + rng.random(), rng.uniform(-5, 5), 3.0])
    days = lambda: [(u, x) for u in (1, 2, 3, None) for x in range(-30, 130) if rng.random() < 0.5]
    tables = {"z": (["za", "zb"], [(*k, some(), some()) for k in days()]), "n": (["na"], [(*k, some()) for k in days()])}
    daily = {
        "z": frame(tables["z"][1], "user_key bigint, date int, za double, zb double"),
        "n": frame(tables["n"][1], "user_key bigint, date int, na double"),
    }
    samples = frame(windows * 3, "user_key bigint, window_start_day int, window_end_day int")
    got = W.window_blocks(samples, daily, ["z"])
    assert [t for _, t in got.dtypes[:3]] == ["bigint", "int", "int"]
    want = brute_blocks(windows, tables)
    rows = {(r["user_key"], r["window_start_day"], r["window_end_day"]): r.asDict() for r in got.collect()}
    assert set(rows) == set(want)
    for k, row in want.items():
        for c, v in row.items():
            assert (rows[k][c] is None) == (v is None) and (v is None or math.isclose(rows[k][c], v, rel_tol=1e-9, abs_tol=1e-6)), (k, c)
    none = W.window_blocks(samples.limit(0), daily, ["z"])
    assert none.columns == got.columns and none.count() == 0


def test_window_blocks_hold_a_great_mean(frame):
    """Deviations of 1e-3 on values of 1e9 survive, as squares of sums would not let them."""
    samples = frame([(1, 0, 3)], "user_key int, window_start_day int, window_end_day int")
    daily = frame([(1, k, 1e9 + (k % 2) * 2e-3) for k in range(4)], "user_key int, date int, a double")
    assert math.isclose(W.window_block(samples, daily, "s").first()["a_window_std"], 1e-3, rel_tol=1e-3)
