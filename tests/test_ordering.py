"""The level-wise ranks must equal plain sorts, also when one key holds most of the rows."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortlake.operators import ordering as O


def skewed(spark, n=600):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), i, rng.choice([0.0, 0.25, 0.999, 1.0, rng.random()])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, id bigint, v double"), pd.DataFrame(rows, columns=["k", "id", "v"])


def test_running_totals_match_a_sort(spark):
    df, pdf = skewed(spark)
    out = O.running_totals(df, ["k"], O.score_levels(F.col("v")), [F.col("v"), F.col("id")], {"cum": F.lit(1)}, totals=True).toPandas()
    pdf = pdf.sort_values(["k", "v", "id"])
    pdf["want"] = pdf.groupby("k").cumcount() + 1
    pdf["size"] = pdf.groupby("k")["id"].transform("size")
    both = out.merge(pdf, on=["k", "id"])
    assert len(both) == len(pdf)
    assert (both["cum"] == both["want"]).all() and (both["cum_total"] == both["size"]).all()


def test_two_levels_and_no_key(spark):
    df, pdf = skewed(spark)
    ids = df.select((F.col("id") * 5000).alias("id"))
    out = O.number_rows(ids, [], O.integer_levels(F.col("id")), [F.col("id")]).toPandas().sort_values("id")
    assert list(out["rn"]) == list(range(1, len(pdf) + 1))


def test_descending_levels(spark):
    df, pdf = skewed(spark)
    out = O.number_rows(df, ["k"], O.score_levels(F.col("v"), True), [F.col("v").desc(), F.col("id")]).toPandas()
    want = pdf.sort_values(["k", "v", "id"], ascending=[True, False, True])
    want["rn"] = want.groupby("k").cumcount() + 1
    both = out.merge(want, on=["k", "id"])
    assert (both["rn_x"] == both["rn_y"]).all()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(0, 50, 400), [7.5] * 200, [-1e9, 1e9]])
    keys = ["hot"] * 500 + ["x"] * (len(values) - 500)
    df = spark.createDataFrame(
        [(k, float(v)) for k, v in zip(keys, values)] + [("hot", None), ("hot", float("nan")), ("none", None)], "k string, v double"
    )
    probs = {"q0": 0.0, "q1": 0.025, "q2": 0.5, "q3": 0.9, "q4": 1.0}
    out = {r["k"]: r for r in O.exact_quantiles(df, ["k"], "v", probs).collect()}
    assert set(out) == {"hot", "x"}
    pdf = pd.DataFrame({"k": keys, "v": values})
    for k, group in pdf.groupby("k"):
        for name, p in probs.items():
            assert abs(out[k][name] - np.quantile(group["v"], p)) < 1e-6 * max(1, abs(np.quantile(group["v"], p)))


def test_quantiles_with_counts(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 10.0, 1)], "k string, v double, n int")
    assert O.exact_quantiles(df, ["k"], "v", {"m": 0.5}, "n").first()["m"] == 1.0


def test_hash_numbering_is_a_permutation(spark):
    df, pdf = skewed(spark)
    a = O.number_by_hash(df, ["k"], ["id"], 1).toPandas()
    b = O.number_by_hash(df, ["k"], ["id"], 2).toPandas()
    for out in (a, b):
        for _, g in out.groupby("k"):
            assert sorted(g["rn"]) == list(range(1, len(g) + 1))
    assert (a.sort_values("id")["rn"].to_numpy() != b.sort_values("id")["rn"].to_numpy()).any()


def test_rare_scores_are_spread_and_in_order(spark):
    rng = random.Random(7)
    scores = [10.0 ** -rng.uniform(9, 14) for _ in range(3000)] + [1 - 10.0 ** -rng.uniform(3, 14) for _ in range(500)]
    scores += [rng.random() for _ in range(500)] + [0.0, -0.0, 1.0, 5e-324, 2.0**-70, 2.0**-10, 1 - 2.0**-10, 1 - 2.0**-53, -1.5, 2.5]
    scores += [float(np.nextafter(x, d)) for x in (2.0**-70, 2.0**-10, 1 - 2.0**-10) for d in (0.0, 1.0)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "id bigint, v double")
    bands = df.select("v", O.score_levels(F.col("v"))[0].alias("b")).toPandas().sort_values("v")
    assert not bands["b"].isna().any() and (np.diff(bands["b"]) >= 0).all()
    rare = bands[bands["v"].between(1e-15, 1e-8)]
    assert rare["b"].nunique() > 2500 and rare["b"].value_counts().max() <= 4
    top = O.number_rows(df, [], O.score_levels(F.col("v"), True), [F.col("v").desc(), F.col("id")]).toPandas()
    want = pd.DataFrame({"id": range(len(scores)), "v": scores}).sort_values(["v", "id"], ascending=[False, True])["id"]
    assert list(top.sort_values("rn")["id"]) == list(want)


def test_sparse_ids_beyond_2_to_40(spark):
    rng = random.Random(8)
    ids = sorted({rng.randrange(2**40, 2**62) for _ in range(500)} | {0, 1, 4095, 4096, 2**63 - 1})
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    out = O.number_rows(df, [], O.integer_levels(F.col("id")), [F.col("id")]).toPandas().sort_values("rn")
    assert list(out["id"]) == ids and list(out["rn"]) == list(range(1, len(ids) + 1))
