"""All folds' logistic models at once against one plain fit per fold."""

import math
import random

import numpy as np
import pytest

from cohortlake.plans import folds, models as M


def rows_of(seed, n=240, users=7):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        u = 0 if rng.random() < 0.4 else rng.randrange(users)  # one user holds much
        x = [rng.gauss(u * 0.2, 1), rng.gauss(50, 9), 4.0, float(u == 3) * rng.random()]
        y = int(x[0] + 0.05 * x[1] + rng.gauss(0, 1) > 2.8)
        out.append((k, u, y, *x))
    return out


DDL = "sample_id bigint, user_key bigint, target int, a double, b double, c double, d double"
X = ["a", "b", "c", "d"]


def plain_fit(x, y, c, balanced):
    """Newton on the standardised rows of one fold; returns a scorer."""
    mean, std = x.mean(0), x.std(0, ddof=1)
    scale = lambda v: np.where(std > 1e-9, (v - mean) / np.where(std > 1e-9, std, 1), 0.0)
    z = np.c_[scale(x), np.ones(len(x))]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    penalty, b = np.diag([1 / c] * x.shape[1] + [1e-12]), np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        g = z.T @ (w * (p - y)) + penalty @ b
        b = b - np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + penalty, g)
    return lambda v: 1 / (1 + np.exp(-(np.c_[scale(v), np.ones(len(v))] @ b)))


@pytest.mark.parametrize("balanced, values", [(False, 2_000_000), (True, 60)])
def test_scores_are_those_of_one_fit_per_fold(frame, monkeypatch, balanced, values):
    monkeypatch.setattr(folds, "BLOCK_VALUES", values)  # the small one makes blocks of two folds
    rows = rows_of(3)
    scored, fits = folds.held_out_scores(frame(rows, DDL).repartition(3), X, "user_key", ["user_key", "sample_id"], "target", 0.7, balanced)
    got = {r["sample_id"]: r for r in scored.collect()}
    assert len(got) == len(rows)
    data = np.array([r[3:] for r in rows])
    y, user = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    for u in set(user):
        score = plain_fit(data[user != u], y[user != u], 0.7, balanced)
        for k, p in zip(np.flatnonzero(user == u), score(data[user == u])):
            assert got[k]["user_key"] == u and got[k]["y_true"] == y[k] and math.isclose(got[k]["y_prob"], p, abs_tol=1e-6)
    about = fits.collect()
    assert {r["user_key"] for r in about} == set(user.tolist()) and all(r["gradient"] <= folds.CLOSE for r in about)


def test_scores_are_near_those_of_the_library_fit(frame):
    table = frame(rows_of(4), DDL)
    one = {r["sample_id"]: r["y_prob"] for r in M.out_of_fold(table, X, "lr", {"C": 1.0}).collect()}
    for u in (0, 3):
        model = M.fit(table.filter(f"user_key <> {u}"), X, "lr", {"C": 1.0, "max_iter": 200})
        for r in M.score(model, table.filter(f"user_key = {u}"), ["sample_id"]).collect():
            assert math.isclose(one[r["sample_id"]], r["y_prob"], abs_tol=2e-3)


def test_one_class_folds_missing_keys_and_separable_rows(frame):
    rows = [(k, 1 if k < 5 else 2 if k < 9 else None, int(k < 3), float(k), 1.0, 0.0, -float(k)) for k in range(12)]
    scored, fits = folds.held_out_scores(frame(rows, DDL), X, "user_key", ["user_key", "sample_id"], "target")
    got = {r["sample_id"]: r["y_prob"] for r in scored.collect()}
    assert set(got) == set(range(9)) and all(got[k] is None for k in range(5)) and all(got[k] < 0.5 for k in range(5, 9))
    assert {r["user_key"]: r["gradient"] is None for r in fits.collect()} == {1: True, 2: False}
    none, _ = folds.held_out_scores(frame([], DDL), X, "user_key", ["sample_id"], "target")
    assert none.count() == 0
