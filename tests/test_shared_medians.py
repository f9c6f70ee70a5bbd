"""Trials of one grid cell train on the same rows, so their exact medians are found once per cell."""

from pyspark.sql import functions as F

from cohortlake.operators import splits
from cohortlake.plans import models as M


def test_medians_are_found_once_per_cell(spark, monkeypatch):
    a = F.when(F.col("id") % 7 != 0, F.col("id") % 10 / 10.0)
    rows = spark.range(200).select((F.col("id") % 20).alias("user_key"), "id", a.alias("a"), (F.col("id") % 3 / 3.0).alias("b"))
    rows = rows.withColumn("target", (F.coalesce("a", F.lit(0.0)) + F.col("b") > 0.6).cast("int"))
    cells = rows.withColumn("threshold", F.lit(2)).unionByName(rows.filter("id % 11 < 8").withColumn("threshold", F.lit(3)))
    split = splits.three_way_split(rows)
    trials = [("lr", {"C": 1.0}), ("lr", {"C": 0.01}), ("rf", {"n_estimators": 3, "max_depth": 2})]
    found = []

    class Counted(M.Imputer):
        def fit(self, data, params=None):
            found.append(data.count())
            return super().fit(data, params)

    monkeypatch.setattr(M, "Imputer", Counted)
    swept = M.sweep(cells, split, ["a", "b"], ["threshold"], trials).collect()
    assert len(swept) == 6 and len(found) == 2 and found[0] > found[1]
    # The shared medians give what a trial's own do.
    train = splits.apply_split(rows, split).filter("split = 'train'")
    shared, own = (M.fit(train, ["a", "b"], "lr", {"C": 1.0}, shared=s) for s in (M.medians(train, ["a", "b"]), None))
    assert shared.stages[-1].coefficients == own.stages[-1].coefficients
