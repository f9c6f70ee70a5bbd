"""User-disjoint splits and train-only preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.catalogue import timeseries as TS
from cohortlake.catalogue.common import minutes, rounded, sql_rounded
from cohortlake.catalogue.ctes import cte
from cohortlake.catalogue.registry import query
from cohortlake.operators import prep, splits
from cohortlake.sources import standin as V

cte("users", "minutes", "SELECT DISTINCT user_key FROM minutes")
cte("split3", "users", """
SELECT user_key, CASE WHEN rn <= greatest(1, ceil(n * 0.2::DOUBLE)) THEN 'test'
  WHEN rn <= greatest(1, ceil(n * 0.2::DOUBLE)) + greatest(1, ceil(n * 0.15::DOUBLE)) THEN 'val' ELSE 'train' END AS split
FROM (SELECT user_key, row_number() OVER (ORDER BY md5('42:' || user_key), user_key) AS rn, count(*) OVER () AS n FROM users)
""")


@query("spl_01_three_way_split", "SELECT * FROM split3", "split3")
def _(spark, d):
    return splits.three_way_split(minutes(spark, d))


@query(
    "spl_02_two_way_split",
    """SELECT user_key, CASE WHEN row_number() OVER (ORDER BY md5('42:' || user_key), user_key) <= ceil(count(*) OVER () * 0.25::DOUBLE)
         THEN 'test' ELSE 'train' END AS split FROM users""",
    "users",
)
def _(spark, d):
    return splits.two_way_split(minutes(spark, d))


@query("spl_03_nested_split", TS.NEST.format(src="users"), "users")
def _(spark, d):
    return splits.nested_split(minutes(spark, d))


cte("user_pos", "labelled", "SELECT user_key, sum(target_binary) AS pos, count(*) AS n FROM labelled GROUP BY user_key")
TRIAL = """
SELECT user_key FROM (SELECT *, min(pick) OVER () AS best FROM (
  SELECT user_key, trial, (lpad(CAST(CAST(round(gap, 12) * 1e12 AS BIGINT) AS VARCHAR), 16, '0') || lpad(CAST(trial AS VARCHAR), 4, '0')) AS pick FROM (
    SELECT user_key, trial, abs(sum(pos) OVER (PARTITION BY trial) / CAST(sum(n) OVER (PARTITION BY trial) AS DOUBLE)
           - (SELECT sum(pos) / CAST(sum(n) AS DOUBLE) FROM user_pos)) AS gap
    FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY md5('42:{part}:' || trial || ':' || user_key), user_key) AS rn
          FROM {src}, (SELECT unnest(range(64)) AS trial))
    WHERE rn <= {k})))
WHERE pick = best
"""
cte("strat_test", "user_pos", TRIAL.format(part="outer", src="user_pos", k="greatest(2, round_even((SELECT count(*) FROM user_pos) * 0.25::DOUBLE, 0))"))
cte("strat_rest", "user_pos strat_test", "SELECT * FROM user_pos WHERE user_key NOT IN (SELECT user_key FROM strat_test)")
cte("strat_val", "strat_rest", TRIAL.format(part="inner", src="strat_rest", k="greatest(1, round_even((SELECT count(*) FROM strat_rest) * 0.2::DOUBLE, 0))"))


@query(
    "spl_04_stratified_split",
    """SELECT user_key, CASE WHEN user_key IN (SELECT user_key FROM strat_test) THEN 'test'
         WHEN user_key IN (SELECT user_key FROM strat_val) THEN 'val' ELSE 'train' END AS split FROM user_pos""",
    "strat_val strat_test",
)
def _(spark, d):
    from cohortlake.catalogue.labelling import labelled

    return splits.stratified_split(labelled(spark, d), "target_binary", n_trials=64)


@query(
    "spl_05_group_folds",
    """SELECT user_key, n, CAST(CASE WHEN ((rn - 1) // 5) % 2 = 0 THEN (rn - 1) % 5 ELSE 4 - (rn - 1) % 5 END AS INTEGER) AS fold FROM (
         SELECT user_key, n, row_number() OVER (ORDER BY n DESC, md5('fold:' || user_key), user_key) AS rn
         FROM (SELECT user_key, count(*) AS n FROM minutes GROUP BY user_key))""",
    "minutes",
)
def _(spark, d):
    return splits.group_folds(minutes(spark, d), 5)


@query(
    "spl_06_leave_one_out",
    """SELECT user_key AS held_out_user, n AS n_test, CAST(sum(n) OVER () - n AS BIGINT) AS n_train
       FROM (SELECT user_key, count(*) AS n FROM minutes GROUP BY user_key)""",
    "minutes",
)
def _(spark, d):
    return splits.leave_one_out(minutes(spark, d))


@query(
    "snk_05_split_manifest",
    "SELECT split, count(*) AS users FROM split3 GROUP BY split",
    "split3",
)
def _(spark, d):
    from cohortlake.sources.tables import scratch_dir, write_split

    path = f"{scratch_dir(spark)}/split"
    write_split(splits.three_way_split(minutes(spark, d)), path)
    return spark.read.schema("user_key BIGINT, split STRING").json(path).groupBy("split").agg(F.count("*").alias("users"))


@query("src_07_split_scan", "SELECT * FROM split3", "split3")
def _(spark, d):
    from cohortlake.sources.tables import read_split, scratch_dir, write_split

    path = f"{scratch_dir(spark)}/split"
    write_split(splits.three_way_split(minutes(spark, d)), path)
    return read_split(spark, path)


# --- preprocessing --------------------------------------------------------------------------------

FEATS = ["hr_mean", "hr_std", "steps_mean", "intensity_mean"]
cte("feature_split", "hop_features", """
SELECT f.*, s.split FROM hop_features f JOIN (
  SELECT user_key, CASE WHEN rn <= greatest(1, ceil(n * 0.2::DOUBLE)) THEN 'test'
    WHEN rn <= greatest(1, ceil(n * 0.2::DOUBLE)) + greatest(1, ceil(n * 0.15::DOUBLE)) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT user_key, row_number() OVER (ORDER BY md5('42:' || user_key), user_key) AS rn, count(*) OVER () AS n
        FROM (SELECT DISTINCT user_key FROM hop_features))) s USING (user_key)
""")


def feature_split(spark, d):
    from cohortlake.sources.tables import materialize

    rows = materialize(TS.hop_features(spark, d))
    return splits.apply_split(rows, splits.three_way_split(rows)).select("user_key", "anchor_relative_minute", "split", *FEATS)


def _cols(fmt: str) -> str:
    return ", ".join(fmt.format(c=c) for c in FEATS)


@query(
    "pre_01_median_imputation",
    sql_rounded(FEATS, f"""SELECT f.user_key, f.anchor_relative_minute, f.split, {_cols('coalesce(f.{c}, m.{c}) AS {c}')}
       FROM feature_split f, (SELECT {_cols('quantile_cont({c}, 0.5) AS {c}')} FROM feature_split WHERE split = 'train') m"""),
    "feature_split",
)
def _(spark, d):
    return rounded(prep.impute_median(feature_split(spark, d), FEATS, F.col("split") == "train"))


PRE_03 = f"""SELECT f.user_key, f.anchor_relative_minute, f.split, {_cols('coalesce((f.{c} - m.{c}) / s.{c}, 0) AS {c}')}
       FROM feature_split f, (SELECT {_cols('avg({c}) AS {c}')} FROM feature_split WHERE split = 'train') m,
            (SELECT {_cols('CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}')} FROM feature_split WHERE split = 'train') s"""


@query("pre_03_standardize", sql_rounded(FEATS, PRE_03), "feature_split")
def _(spark, d):
    return rounded(prep.standardize(feature_split(spark, d), FEATS, F.col("split") == "train"))


DIMS = range(64)


@query(
    "pre_02_standard_scaling",
    sql_rounded([f"x{i}" for i in DIMS], f"""SELECT v.sample_id, {', '.join(f'(v.x{i} - m.x{i}) / s.x{i} AS x{i}' for i in DIMS)}
       FROM (SELECT sample_id, {', '.join(f'embedding[{i + 1}] AS x{i}' for i in DIMS)} FROM vectors) v,
            (SELECT {', '.join(f'avg(embedding[{i + 1}]) AS x{i}' for i in DIMS)} FROM vectors WHERE user_key < 9) m,
            (SELECT {', '.join(f'stddev_pop(embedding[{i + 1}]) AS x{i}' for i in DIMS)} FROM vectors WHERE user_key < 9) s""", 5),
    "vectors",
)
def _(spark, d):
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = V.vectors(spark, d).select("sample_id", "user_key", array_to_vector(F.slice("embedding", 1, len(DIMS))).alias("x"))
    train = v.filter("user_key < 9")
    model = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(train)
    # MLlib divides by the sample deviation; the factor turns it into the population one.
    n = train.count()
    factor = (n / (n - 1)) ** 0.5
    z = vector_to_array("z")
    return rounded(model.transform(v).select("sample_id", *[(z[i] * factor).alias(f"x{i}") for i in DIMS]), 5)


@query(
    "pre_04_standardize_per_user",
    sql_rounded(FEATS, f"""SELECT f.user_key, f.anchor_relative_minute, f.split,
         {_cols('coalesce((f.{c} - coalesce(u.m_{c}, g.m_{c})) / CASE WHEN u.s_{c} >= 0.001 THEN u.s_{c} WHEN g.s_{c} < 0.001 THEN 1 ELSE g.s_{c} END, 0) AS {c}')}
       FROM feature_split f LEFT JOIN (SELECT user_key, {_cols('avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}')} FROM feature_split WHERE split = 'train' GROUP BY user_key) u
         ON u.user_key = f.user_key, (SELECT {_cols('avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}')} FROM feature_split WHERE split = 'train') g"""),
    "feature_split",
)
def _(spark, d):
    return rounded(prep.standardize_per_user(feature_split(spark, d), FEATS, F.col("split") == "train"))


@query(
    "pre_06_class_weights",
    sql_rounded("balanced_weight scale_pos_weight", """SELECT target, n, (SELECT count(*) FROM vectors) / (2.0::DOUBLE * n) AS balanced_weight,
         (SELECT count(*) FILTER (target = 0) / CAST(count(*) FILTER (target = 1) AS DOUBLE) FROM vectors) AS scale_pos_weight
       FROM (SELECT target, count(*) AS n FROM vectors GROUP BY target)"""),
    "vectors",
)
def _(spark, d):
    return rounded(prep.class_weights(V.vectors(spark, d).select("target"), "target"))
