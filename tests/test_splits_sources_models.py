import json

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import prep, splits
from cohortlake.plans import features as X, models as M
from cohortlake.sources import schemas as S, tables as T


@pytest.mark.parametrize("n,want", [(3, (1, 1, 1)), (10, (2, 2, 6)), (41, (9, 7, 25))])
def test_three_way_sizes(spark, n, want):
    users = spark.range(n).select((F.col("id") * 3).alias("user_key"))
    split = splits.three_way_split(users.union(users))
    got = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert (got["test"], got["val"], got["train"]) == want
    assert split.select("user_key").distinct().count() == n


def test_too_few_users_and_bad_fractions(spark):
    with pytest.raises(ValueError):
        splits.three_way_split(spark.range(2).withColumnRenamed("id", "user_key"))
    with pytest.raises(ValueError):
        splits.three_way_split(spark.range(9).withColumnRenamed("id", "user_key"), val_frac=0.6, test_frac=0.5)


def test_stratified_split_is_disjoint_and_close(spark):
    rows = spark.range(2000).select((F.pmod(F.col("id"), F.lit(20))).alias("user_key"), (F.pmod(F.col("id") * 7, F.lit(9)) < 3).cast("int").alias("y"))
    split = splits.stratified_split(rows, "y", n_trials=8)
    got = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert got == {"test": 5, "val": 3, "train": 12}


def test_folds_are_balanced(spark):
    rows = spark.range(1000).select(F.floor(F.sqrt("id")).alias("user_key"))
    sizes = [r[1] for r in splits.group_folds(rows, 4).groupBy("fold").agg(F.sum("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) - min(sizes) < 70


def test_standardize_uses_training_rows_only(frame):
    df = frame([("train", 1.0, 5.0), ("train", 3.0, 5.0), ("test", 9.0, None)], "split string, a double, b double")
    out = [tuple(r) for r in prep.standardize(df, ["a", "b"], F.col("split") == "train").collect()]
    assert out == [("train", -1.0, 0.0), ("train", 1.0, 0.0), ("test", 7.0, 0.0)]


def test_per_user_standardize_falls_back(frame):
    rows = [(1, "train", 0.0), (1, "train", 4.0), (2, "train", 7.0), (2, "train", 7.0), (3, "test", 4.5)]
    df = frame(rows, "user_key int, split string, a double")
    out = {(r["user_key"], i): r["a"] for i, r in enumerate(prep.standardize_per_user(df, ["a"], F.col("split") == "train").orderBy("user_key", "a").collect())}
    spread = (sum((v - 4.5) ** 2 for v in (0, 4, 7, 7)) / 4) ** 0.5
    assert out[(1, 0)] == -1.0 and out[(1, 1)] == 1.0 and out[(2, 2)] == 0.0 and out[(3, 4)] == pytest.approx(0.0 / spread)


def test_imputation_drops_all_null_training_columns(frame):
    df = frame([("train", 1.0, None), ("train", None, None), ("test", None, 2.0)], "split string, a double, b double")
    out = prep.impute_median(df, ["a", "b"], F.col("split") == "train")
    assert out.columns == ["split", "a"] and [r["a"] for r in out.collect()] == [1.0, 1.0, 1.0]


def test_csv_by_name_with_na_and_extra_columns(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("hr,user_key,date,time,activity_type,intensity,steps,extra\n70,1,0,00:01:00,1,2,3,x\nNA,1.0,0,00:02:00,NA,NaN,bad,x\n")
    b.write_text('"user_key","date","time","activity_type","intensity","steps","hr"\n"2",-1,00:01:00,1,2,3,70\n')
    out = T.read_smartwatch(spark, [str(a), str(b)]).orderBy("user_key", "time").collect()
    assert tuple(out[1]) == (1, 0, "00:02:00", None, None, None, None) and tuple(out[2])[:2] == (2, -1)
    assert out[0]["hr"] == 70.0
    with pytest.raises(KeyError):
        T.read_csv(spark, str(b), S.INHALER)


def test_grid_scan_names_missing_cells(frame, spark, tmp_path):
    df = frame([(2, 7, 0, 1), (3, 7, 0, 2)], "threshold int, input_length_days int, washout_days int, v int")
    T.write_grid(df, str(tmp_path / "g"))
    assert [r["v"] for r in T.read_grid(spark, str(tmp_path / "g"), [(3, 7, 0)]).collect()] == [2]
    with pytest.raises(FileNotFoundError, match=r"\(4, 7, 0\)"):
        T.read_grid(spark, str(tmp_path / "g"), [(3, 7, 0), (4, 7, 0)])


def test_fallback_optional_and_manifest(spark, frame, tmp_path):
    with pytest.raises(FileNotFoundError):
        T.read_parquet_or_csv(spark, str(tmp_path / "p"), str(tmp_path / "c"), S.INHALER)
    assert T.read_optional(spark, [str(tmp_path / "none")]) is None
    (tmp_path / "split.json").write_text(json.dumps({"seed": 42, "val_frac": 0.15, "test_frac": 0.2, "train_users": [1, 2], "val_users": [3], "test_users": [4]}, indent=1))
    out = {r["user_key"]: r["split"] for r in T.read_split_manifest(spark, str(tmp_path / "split.json")).collect()}
    assert out == {1: "train", 2: "train", 3: "val", 4: "test"}


def test_no_scratch_without_the_cluster_setting():
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        T.scratch_dir(Session())


def test_scratch_follows_the_cluster_setting():
    class Conf:
        def get(self, key, default=None):
            return "hdfs://shared/cp/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    first, second = T.scratch_dir(Session()), T.scratch_dir(Session())
    assert first.startswith("hdfs://shared/cp/scratch-") and first != second


def test_source_names():
    assert X.source_tag(None) == "all" and X.source_tag(["peakflow", "smartwatch"]) == "smartwatch+peakflow"
    with pytest.raises(ValueError):
        X.pick_sources(["scale"])


def test_sequence_arrays(frame):
    windows = frame([(1, 4)], "user_key int, anchor_relative_minute bigint")
    minutes = frame([(1, 0, 5.0), (1, 2, 7.0), (1, 2, 9.0)], "user_key int, relative_minute bigint, hr double")
    long = X.minute_sequence(windows, minutes, ["hr"], window=4)
    assert [tuple(r) for r in long.select("t", "hr").orderBy("t").collect()] == [(0, 5.0), (1, None), (2, 8.0), (3, None)]
    assert X.as_arrays(long, ["user_key"], ["hr"]).first()["sequence"] == [[5.0], [0.0], [8.0], [0.0]]


def blobs(spark, n=120):
    x = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    return spark.range(n).select(
        F.col("id").alias("sample_id"), F.pmod(F.col("id"), F.lit(6)).alias("user_key"), x.alias("a"),
        F.when(F.col("id") % 5 > 0, x * x).alias("b"), F.lit(None).cast("double").alias("c"), (x > 0.5).cast("int").alias("target"),
    )


@pytest.mark.parametrize("algo,params", [("lr", {"class_weight": "balanced"}), ("rf", {"n_estimators": 5, "max_depth": 3}), ("gbt", {"n_estimators": 3})])
def test_models_learn_and_skip_empty_columns(spark, algo, params):
    df = blobs(spark)
    model = M.fit(df.filter("user_key < 4"), ["a", "b", "c"], algo, params)
    assert model.feature_names == ["a", "b"]
    from cohortlake.operators.ranking import auc

    out = M.score(model, df.filter("user_key >= 4"), ["user_key"]).withColumn("config", F.lit(algo))
    assert auc(out, ["config"]).first()["roc_auc"] > 0.9


def test_lopo_covers_every_row_once(spark):
    df = blobs(spark, 40)
    oof = M.lopo(df, ["a", "b"], "lr", {"max_iter": 5})
    assert oof.count() == 40 and oof.select("sample_id").distinct().count() == 40
    alone = df.withColumn("target", (F.col("user_key") == 0).cast("int"))
    assert M.lopo(alone, ["a"], "lr", {"max_iter": 5}).filter("user_key = 0 and y_prob is null").count() == df.filter("user_key = 0").count()


def test_ensemble_and_majority(frame):
    p = frame([(1, "a", 1, 0.2), (1, "b", 1, 0.8)], "sample_id int, model string, y_true int, y_prob double")
    assert M.ensemble(p, ["sample_id"], "model", {"a": 0.6, "b": 0.4}).first()["y_prob"] == pytest.approx(0.44)
    rows = frame([(0,), (1,), (1,)], "target int")
    assert {r["y_pred"] for r in M.majority_baseline(rows, rows).collect()} == {1}


def test_more_users_than_any_limit(spark, monkeypatch):
    df = blobs(spark, 2400).withColumn("user_key", F.pmod("sample_id", F.lit(1200)))
    walked = []

    def fitted(train, features, algo, params, seed):
        walked.append(1)
        return None

    monkeypatch.setattr(M, "fit", fitted)
    monkeypatch.setattr(M, "score", lambda model, test, keep: test.select(*keep, F.lit(1).alias("y_true"), F.lit(0.5).alias("y_prob")))
    monkeypatch.setattr(M.ScoreTable, "has", lambda self, **labels: False)
    added = []
    monkeypatch.setattr(M.ScoreTable, "add", lambda self, scored, **labels: added.append(labels["held"]))
    monkeypatch.setattr(M.ScoreTable, "read", lambda self: spark.createDataFrame([(h,) for h in added], "held string"))
    M.lopo(df, ["a"], "lr", {})
    assert len(walked) == len(set(added)) == 1200


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    df, path = blobs(spark, 60), str(tmp_path / "scores")
    whole = sorted(map(tuple, M.lopo(df, ["a"], "lr", {"max_iter": 5}, path=path).collect()))
    fits = []
    real = M.fit
    monkeypatch.setattr(M, "fit", lambda *a, **k: (fits.append(1), real(*a, **k))[1])
    assert sorted(map(tuple, M.lopo(df, ["a"], "lr", {"max_iter": 5}, path=path).collect())) == whole and not fits


def test_from_sweep_to_headline(spark):
    from cohortlake.operators import select
    from cohortlake.plans import reports

    df = blobs(spark, 240)
    cells = df.withColumn("threshold", F.lit(2)).unionByName(df.filter("sample_id % 4 < 2").withColumn("threshold", F.lit(3)))
    cells = cells.withColumns({"input_length_days": F.lit(7), "washout_days": F.lit(0)})
    split = spark.createDataFrame([(u, s) for u, s in enumerate(["train", "train", "train", "val", "test", "train"])], "user_key bigint, split string")
    trials = M.param_grid({"lr": {"C": [0.1, 1.0]}, "rf": {"n_estimators": [5], "max_depth": [3]}})
    keys = ["threshold", "input_length_days", "washout_days"]
    swept, final = M.tune_and_test(cells, split, ["a", "b"], keys, trials)
    rows = swept.collect()
    assert sorted(r["trial_id"] for r in rows) == list(range(6))
    assert not [c for c in swept.columns if c.startswith("test_")] and all(r["val_tuned_f1"] is not None and r["tuned_threshold"] is not None for r in rows)
    assert all(r["n_features"] == 2 and r["val_precision_at_recall_floor"] is not None for r in rows)
    best = {r["algo"]: r["trial_id"] for r in select.best_trials(swept, ["algo"]).collect()}
    out = {r["name"]: r for r in reports.headline(final).collect()}
    assert {r["algo"]: r["trial_id"] for r in final.collect()} == best and set(out) == {"lr", "rf"}
    assert all(r["test_pr_auc"] > 0.8 and r["val_test_pr_auc_gap"] is not None for r in out.values())


def test_only_unfit_trials_become_empty_rows(spark, monkeypatch):
    df = blobs(spark, 60).withColumn("threshold", F.lit(2))
    split = spark.createDataFrame([(u, s) for u, s in enumerate(["train", "train", "train", "val", "test", "train"])], "user_key bigint, split string")
    empty = M.sweep(df, split, ["c"], ["threshold"], [("lr", {})]).collect()
    assert [r["trial_id"] for r in empty] == [0]

    def broken(*a, **k):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(M, "fit", broken)
    with pytest.raises(RuntimeError, match="executor lost"):
        M.sweep(df, split, ["a"], ["threshold"], [("lr", {})])


def test_deep_trees_are_refused():
    assert M.tree_depth(None) == 30 and M.tree_depth(7) == 7
    with pytest.raises(ValueError, match="31"):
        M.tree_depth(31)
