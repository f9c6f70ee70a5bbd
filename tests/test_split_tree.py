"""The bootstrap by a splitting tree against plain resampling with the same multiplicities."""

import hashlib

import numpy as np
import pytest

from cohortlake.operators import splittree as ST


def plain(scores, labels, weights):
    """(roc_auc, pr_auc) of weighted rows, pair by pair and cut by cut."""
    pos, neg = [(s, w) for s, y, w in zip(scores, labels, weights) if y], [(s, w) for s, y, w in zip(scores, labels, weights) if not y]
    up, down = sum(w for _, w in pos), sum(w for _, w in neg)
    if not up:
        return None, None
    pairs = sum(a * b * ((s > t) + (s == t) / 2) for s, a in pos for t, b in neg)
    steps = sum(w * sum(b for t, b in pos if t >= s) / sum(b for t, b in pos + neg if t >= s) for s, w in pos if w)
    return (pairs / (up * down) if down else None), steps / up


def test_any_task_finds_the_same_split():
    whole = ST.draws_below(np.arange(0, 1001), 1000, 50, 3)
    assert (whole[-1] == 1000).all() and (np.diff(whole, axis=0) >= 0).all()
    some = np.array([0, 1, 17, 500, 501, 998, 1000])
    assert (ST.draws_below(some, 1000, 50, 3) == whole[some]).all()
    assert (ST.draws_below(np.array([640]), 1000, 50, 3) == whole[640]).all()


def test_multiplicities_are_multinomial():
    size, n_boot = 7, 40_000
    w = np.diff(ST.draws_below(np.arange(size + 1), size, n_boot, 1), axis=0)
    assert (w.sum(axis=0) == size).all()
    want = np.full((size, size), -1 / size) + np.eye(size)  # covariance of counts: size * (diag(p) - p p')
    assert np.abs(w.mean(axis=1) - 1).max() < 0.03
    assert np.abs(np.cov(w) - want).max() < 0.04
    never = (w == 0).mean(axis=1)
    assert np.abs(never - (1 - 1 / size) ** size).max() < 0.015


def test_a_few_bounds_of_a_huge_table_cost_a_path():
    size = 10**12
    below = ST.draws_below(np.array([1, size // 3, size - 1]), size, 100, 5)
    assert (below[0] <= 20).all() and abs(below[1].mean() / size - 1 / 3) < 1e-6


@pytest.mark.parametrize("block", [1, 4, 512])
def test_metrics_are_those_of_the_drawn_rows(frame, block):
    rng = np.random.default_rng(2)
    rows = [("a", int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(40)]
    rows += [("b", int(rng.random() < 0.1), rng.random() * 1e-9) for _ in range(15)] + [("c", 1, 0.5), ("a", 1, None)]
    df = frame(rows, "config string, y_true int, y_prob double")
    got = ST.row_bootstrap(df, ["config"], 6, 9, block).toPandas().set_index(["config", "draw"])
    assert len(got) == 18
    for config in "abc":
        kept = sorted(((s, y) for c, y, s in rows if c == config and s is not None), reverse=True)
        w = np.diff(ST.draws_below(np.arange(len(kept) + 1), len(kept), 6, 9), axis=0)
        for draw in range(6):
            roc, pr = plain([s for s, _ in kept], [y for _, y in kept], [int(x) for x in w[:, draw]])
            row = got.loc[(config, draw)]
            assert row.n == len(kept) and row.pos == sum(x * y for x, (_, y) in zip(w[:, draw], kept))
            for have, want in ((row.roc_auc, roc), (row.pr_auc, pr)):
                assert (np.isnan(have) and want is None) or have == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("block", [1, 4, 512])
def test_whole_users_are_drawn(frame, block):
    rng = np.random.default_rng(4)
    rows = [("a", f"u{u}", int(rng.random() < 0.4), float(rng.choice([0.0, 0.0, 0.0, 0.2, 0.7]))) for u in range(12) for _ in range(1 + u % 4)]
    rows += [("b", f"u{u}", u % 2, rng.random()) for u in range(9)] + [("a", "u99", 1, None)]
    df = frame(rows, "config string, u string, y_true int, y_prob double")
    got = ST.user_bootstrap(df, ["config"], "u", 6, 9, block).toPandas().set_index(["config", "draw"])
    assert len(got) == 12
    for config in "ab":
        users = sorted({u for c, u, _, _ in rows if c == config}, key=lambda u: (hashlib.md5(f"users:{u}".encode()).hexdigest(), u))
        w = np.diff(ST.draws_below(np.arange(len(users) + 1), len(users), 6, 9), axis=0)
        kept = [(users.index(u), y, s) for c, u, y, s in rows if c == config and s is not None]
        for draw in range(6):
            times = [int(w[i, draw]) for i, _, _ in kept]
            roc, pr = plain([s for _, _, s in kept], [y for _, y, _ in kept], times)
            row = got.loc[(config, draw)]
            assert row.n == sum(times) and row.pos == sum(t * y for t, (_, y, _) in zip(times, kept))
            for have, want in ((row.roc_auc, roc), (row.pr_auc, pr)):
                assert (np.isnan(have) and want is None) or have == pytest.approx(want, abs=1e-12)


def test_an_empty_table_gives_no_rows(frame):
    assert ST.row_bootstrap(frame([], "config string, y_true int, y_prob double"), ["config"], 3).count() == 0
