import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import ranking as R, resample as RS, select

DDL = "config string, user_key string, sample_id bigint, y_true int, y_prob double"


def preds(n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        config = rng.choice(["a", "a", "a", "b"])
        y = int(rng.random() < 0.3)
        rows.append((config, f"u{rng.choice([0, 0, 0, 1, 2, 3])}", i, y, rng.choice([0.0, 0.5, 1.0, round(rng.random(), 2), 1e-7 * i])))
    rows += [("one", "u0", n + i, 0, 0.1 * i) for i in range(6)] + [("pos", "u1", n + 10 + i, 1, 0.2 * i) for i in range(3)]
    return rows


def brute(y, p):
    y, p = np.asarray(y), np.asarray(p)
    pos, neg = p[y == 1], p[y == 0]
    roc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) if len(pos) and len(neg) else None
    ap = None
    if len(pos):
        ap, last = 0.0, 0.0
        for t in sorted(set(p), reverse=True):
            rec = (pos >= t).sum() / len(pos)
            ap += (rec - last) * (pos >= t).sum() / (p >= t).sum()
            last = rec
    return roc, ap


def test_auc_against_pairs(frame):
    rows = preds()
    pdf = pd.DataFrame(rows, columns=["config", "user_key", "sample_id", "y_true", "y_prob"])
    for r in R.auc(frame(rows, DDL), ["config"]).collect():
        g = pdf[pdf["config"] == r["config"]]
        roc, ap = brute(g["y_true"], g["y_prob"])
        assert (r["roc_auc"] is None) == (roc is None) and (r["pr_auc"] is None) == (ap is None)
        if roc is not None:
            assert r["roc_auc"] == pytest.approx(roc) and r["pr_auc"] == pytest.approx(ap)


def test_one_class_panel_is_null(frame):
    out = {r["config"]: r for r in R.panel(frame(preds(), DDL), ["config"]).collect()}
    assert out["one"]["roc_auc"] is None and out["one"]["brier"] is None and out["one"]["precision"] == 0.0
    assert out["pos"]["pr_auc"] is None and R.auc(frame(preds(), DDL), ["config"]).filter("config = 'pos'").first()["pr_auc"] == 1.0


def test_thresholds_by_brute_force(frame):
    rows = preds()
    pdf = pd.DataFrame(rows, columns=["config", "user_key", "sample_id", "y_true", "y_prob"])
    df = frame(rows, DDL)
    f1 = {r["config"]: r for r in R.best_f1_threshold(df, ["config"]).collect()}
    rec = {r["config"]: r for r in R.recall_at_precision(df, ["config"], 0.4).collect()}
    pre = {r["config"]: r for r in R.precision_at_recall(df, ["config"], 0.6).collect()}
    for c in ("a", "b"):
        y, p = (pdf[pdf["config"] == c][x].to_numpy() for x in ("y_true", "y_prob"))

        def at(t):
            hit = p >= t
            tp = (hit & (y == 1)).sum()
            return tp / hit.sum(), tp / y.sum(), 2 * tp / (hit.sum() + y.sum())

        cuts = sorted(set(p) | {0.5})
        best = max((at(t)[2], -t) for t in cuts if (p >= t).any())
        assert f1[c]["best_f1"] == pytest.approx(best[0]) and f1[c]["score_cut"] == -best[1]
        ok = [(at(t)[1], -t) for t in set(p) if at(t)[0] >= 0.4]
        want = max(ok) if ok else (0.0, None)
        assert rec[c]["recall_at_precision_floor"] == pytest.approx(want[0])
        assert rec[c]["score_cut"] == (None if want[1] is None else -want[1])
        want = max((at(t)[0], -t) for t in set(p) if at(t)[1] >= 0.6)
        assert pre[c]["precision_at_recall_floor"] == pytest.approx(want[0]) and pre[c]["score_cut"] == -want[1]
    assert f1["one"]["score_cut"] == 0.5 and rec["one"]["recall_at_precision_floor"] is None


def test_sweep_counts(frame):
    df = frame(preds(), DDL)
    row = R.threshold_sweep(df, ["config"]).filter("config = 'a' and score_cut = 0.29").first()
    base = df.filter("config = 'a'")
    assert row["tp"] == base.filter("y_prob >= 0.29 and y_true = 1").count()
    assert row["tn"] == base.filter("y_prob < 0.29 and y_true = 0").count()


def test_weighted_auc_equals_repeated_rows(frame):
    rows = [("a", "u", i, y, p, w) for i, (y, p, w) in enumerate([(1, 0.9, 3), (0, 0.9, 1), (0, 0.2, 5), (1, 0.1, 2)])]
    weighted = R.auc(frame(rows, DDL + ", w int"), ["config"], "w").first()
    plain = R.auc(frame([r[:5] for r in rows for _ in range(r[5])], DDL), ["config"]).first()
    assert tuple(weighted) == tuple(plain)


def test_bootstrap_is_seeded_and_bounded(frame):
    df = frame(preds(120), DDL)

    def draws(rows):
        out = RS.row_bootstrap(rows, ["config"], "sample_id", 10, 1)
        return sorted(map(tuple, out.withColumn("pr_auc", F.round("pr_auc", 9)).collect()))

    a, b = draws(df), draws(df.repartition(7))
    sizes = {r["config"]: r["count"] for r in df.groupBy("config").count().collect()}
    assert a == b and all(r[2] == sizes[r[0]] for r in a)
    ci = {r["config"]: r for r in RS.bootstrap_ci(df, ["config"], "sample_id", 20).collect()}
    assert ci["a"]["roc_auc_lo"] <= ci["a"]["roc_auc_hi"] and ci["pos"]["roc_auc_lo"] is None and ci["one"]["pr_auc_hi"] is None


def test_cluster_bootstrap_draws_whole_users(frame):
    df = frame(preds(120), DDL)
    sizes = {(r["config"], r["user_key"]): r["count"] for r in df.groupBy("config", "user_key").count().collect()}
    for r in RS.cluster_bootstrap(df, ["config"], "user_key", 5).filter("config = 'b'").collect():
        mine = [n for (c, _), n in sizes.items() if c == "b"]
        sums = {0}
        for _ in mine:
            sums = {s + n for s in sums for n in mine}
        assert r["n"] in sums


def test_shuffles_keep_the_labels(frame):
    df = frame(preds(150), DDL)
    mixed = RS.shuffle_labels(df, ["config"], "sample_id", "y_true", 9)
    assert mixed.count() == df.count()
    for r in mixed.groupBy("config").agg(F.sum("y_true").alias("a"), F.sum("y_true_shuffled").alias("b")).collect():
        assert r["a"] == r["b"]


def test_user_blocks_wrap_around(frame):
    rows = [("u1", i, i % 2) for i in range(5)] + [("u2", 10 + i, 1) for i in range(2)] + [("u3", 20, 0)]
    out = RS.permute_user_blocks(frame(rows, "user_key string, sample_id bigint, y int"), "user_key", "sample_id", "y", 4, 3).toPandas()
    labels = pd.DataFrame(rows, columns=["user_key", "id", "y"]).groupby("user_key")["y"].apply(list)
    assert len(out) == 3 * len(rows)
    for (_, user), g in out.groupby(["perm", "user_key"]):
        given = labels[g["donor"].iloc[0]]
        assert list(g.sort_values("sample_id")["y_perm"]) == [given[i % len(given)] for i in range(len(g))]
    assert out.groupby(["perm"])["donor"].nunique().eq(3).all()


def test_p_value(frame):
    null = frame([("c", float(v)) for v in (0.4, 0.5, 0.6, 0.7)] + [("c", None)], "config string, roc_auc double")
    out = RS.permutation_summary(null, frame([("c", 0.6)], "config string, roc_auc double")).first()
    assert out["null_n"] == 4 and out["p_value"] == 3 / 5


def test_selection_order(frame):
    ddl = "trial_id int, g string, val_pr_auc double, val_recall_at_precision_floor double, train_pr_auc double, val_brier double"
    rows = [(1, "x", 0.5, 0.2, 0.9, 0.1), (2, "x", 0.5, 0.3, 0.9, 0.1), (3, "x", None, 0.9, 0.9, 0.0), (4, "y", 0.5, 0.2, 0.9, 0.1), (5, "y", 0.5, 0.2, 0.6, 0.3), (6, "y", 0.5, None, 0.5, 0.0)]
    out = {r["g"]: r["trial_id"] for r in select.best_trials(frame(rows, ddl), ["g"]).collect()}
    assert out == {"x": 2, "y": 5}
    assert select.overall_best(frame(rows, ddl)).first()["trial_id"] == 2
    with pytest.raises(KeyError):
        select.best_trials(frame([(1,)], "trial_id int"), [])


def test_top_k_with_a_hot_group(frame):
    rows = [(i, "hot" if i % 10 else "cold", float(i * 37 % 101)) for i in range(300)]
    out = select.top_k(frame(rows, "id int, g string, v double"), ["g"], F.col("v"), 4, "id").toPandas()
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"]).sort_values(["v", "id"], ascending=[False, True])
    for g, part in out.groupby("g"):
        assert list(part.sort_values("rank")["id"]) == list(pdf[pdf["g"] == g].head(4)["id"])


def test_diagnostics_without_columns(frame):
    out = select.diagnostics(frame([(1, 0.9, 0.5, 0.0)], "trial_id int, train_pr_auc double, val_pr_auc double, val_recall double")).first()
    assert out["train_val_pr_auc_gap"] == pytest.approx(0.4) and out["val_test_pr_auc_gap"] is None
    assert out["overfit_gap_flag"] and out["low_val_event_detection_flag"]


def test_auc_of_more_rows_than_a_bigint_product_can_hold(frame):
    df = frame([("a", 1, 0.9, 4_000_000_000), ("a", 0, 0.1, 4_000_000_000), ("a", 0, 0.95, 4_000_000_000)], "config string, y_true int, y_prob double, w bigint")
    row = R.auc(df, ["config"], "w").first()
    assert row["n"] == 12_000_000_000 and abs(row["roc_auc"] - 0.5) < 1e-12


def test_draws_reach_beyond_32_bits(frame):
    from pyspark.sql import functions as F

    from cohortlake.functions import exprs as E

    df = frame([(i,) for i in range(200)], "slot int").select(E.hash_index(1, F.lit(10**14), "slot").alias("i"))
    found = [r["i"] for r in df.collect()]
    assert max(found) > 2**33 and all(0 <= i < 10**14 for i in found)
