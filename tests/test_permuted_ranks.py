"""Permutation nulls from ranks against metrics of really permuted rows."""

import numpy as np
import pytest

from cohortlake.operators import ranking, resample as RS

DDL = "user_key string, sample_id bigint, y int, y_prob double"


def both(frame, rows, n_perm):
    df = frame(rows, DDL)
    got = RS.permuted_roc(df, "user_key", "sample_id", "y", "y_prob", 5, n_perm).toPandas().set_index("perm")
    mixed = RS.permute_user_blocks(df, "user_key", "sample_id", "y", 5, n_perm)
    want = ranking.auc(mixed.selectExpr("perm", "y_perm as y_true", "y_prob"), ["perm"]).toPandas().set_index("perm")
    return got.sort_index(), want.sort_index()


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_ranks_give_the_metrics_of_permuted_rows(frame, monkeypatch, chunk):
    monkeypatch.setattr(RS, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    rows = []
    for u, size in enumerate([1, 2, 3, 7, 8, 25, 60]):  # shorter donors wrap, longer ones are cut
        for i in rng.choice(10**6, size, replace=False):
            rows.append((f"u{u}", int(i), int(rng.random() < 0.3), None if rng.random() < 0.1 else round(rng.random(), 1)))
    got, want = both(frame, rows, 9)
    assert list(got.index) == list(range(9))
    assert (got.n == want.n).all() and (got.pos[want.index] == want.pos).all()
    assert got.roc_auc.fillna(-1).tolist() == pytest.approx(want.roc_auc.fillna(-1).tolist(), abs=1e-14)


def test_one_class_has_no_value_but_keeps_its_permutations(frame):
    got, _ = both(frame, [("a", 1, 0, 0.2), ("a", 2, 0, 0.4), ("b", 1, 0, 0.4)], 4)
    assert got.pos.tolist() == [0] * 4 and got.n.tolist() == [3] * 4 and got.roc_auc.isna().all()


def test_an_empty_table_has_no_value(frame):
    got, _ = both(frame, [], 2)
    assert got.roc_auc.isna().all()
