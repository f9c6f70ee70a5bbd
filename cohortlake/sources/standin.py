"""Views over the driver tables that take the place of the study's raw files.

Each view is a projection or one grouping of a driver table, so its size grows with that table.
Study day 0 is 2024-01-02, which leaves one day (-1) before the study for the range filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STUDY_START = "2024-01-02"
POLLEN_WORDS = ["low", "Moderate", "HIGH", "Very High", "none"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("user_key"),
        F.datediff(F.col("ts").cast("date"), F.lit(STUDY_START).cast("date")).alias("date"),
        F.hour("ts").alias("hour"),
        F.substring(F.col("ts").cast("string"), 12, 8).alias("hms"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def raw_minutes(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    kind, k, v = F.col("event_type"), F.col("k"), F.col("value")
    return e.select(
        "user_key",
        "date",
        F.when(k == 77, "25:00:00").otherwise(F.col("hms")).alias("time"),
        F.when(kind == "view", 100 + k % 25).otherwise(k).cast("double").alias("activity_type"),
        F.when(kind != "signup", v / 2).alias("intensity"),
        (k - 5).cast("double").alias("steps"),
        F.when(kind == "click", v - 10).when(kind != "error", v).alias("hr"),
    )


def inhaler(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).filter(F.col("event_type").isin("click", "purchase"))
    return e.select(
        "user_key",
        "date",
        F.when(F.col("k") == 0, 24).otherwise(F.col("hour")).alias("hour"),
        F.when(F.col("k") % 10 != 9, F.concat(F.lit("med_"), (F.col("k") % 3).cast("string"))).alias("name"),
    )


def peakflow(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).filter(F.col("event_type") == "view")
    return e.select(
        "user_key",
        "date",
        "hour",
        F.when(F.col("k") % 7 == 0, 0.0).otherwise(F.col("value") * 3).alias("pef_max"),
        F.when(F.col("k") != 50, F.col("hour") < 12).alias("morning"),
    )


def environment(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).filter(F.col("event_type") == "signup")
    k, v = F.col("k"), F.col("value")
    words = F.array(*[F.lit(w) for w in POLLEN_WORDS])

    def word(i: Column) -> Column:
        return F.try_element_at(words, (F.floor(i) % 6 + 1).cast("int"))

    numeric = {
        "temperature": v, "temperature_min": v - k / 10, "temperature_max": v + k / 10, "pressure": 1000.0 + k,
        "humidity": k, "wind_speed": v / 10, "wind_deg": (k * 3) % 360, "aqi": 1 + k % 5, "co": v * 2, "no": v / 4,
        "no2": v / 5, "o3": v / 6, "so2": v / 7, "pm2_5": v / 8, "pm10": v / 3, "nh3": v / 9,
    }
    return e.select(
        "user_key",
        "date",
        *[c.cast("double").alias(n) for n, c in numeric.items()],
        word(k).alias("grass_pollen"),
        word(k / 2).alias("tree_pollen"),
        word(k / 3).alias("weed_pollen"),
    )


def patient(spark: SparkSession, d: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, d, "customer").select(
        key.alias("user_key"),
        F.col("c_mktsegment").alias("sex"),
        F.when(nation % 5 != 4, F.concat(F.lit("r"), (nation % 5).cast("string"))).alias("region"),
        (350 + nation).cast("double").alias("max_pef_expected"),
        F.when(key % 4 != 0, 300 + nation * 10).cast("double").alias("pef_best"),
        (nation % 3).cast("double").alias("n_inhalers"),
        (F.col("c_acctbal") / 100).alias("pack_years"),
    )


def weekly(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("week_date", (F.floor(F.col("date") / 7).cast("int") + 1) * 7)
    kind, k = F.col("event_type"), F.col("k")
    offset = F.col("date") - F.col("week_date")

    def offsets(cond: Column) -> Column:
        days = F.transform(F.array_sort(F.collect_set(F.when(cond, offset))), lambda x: x.cast("string"))
        return F.nullif(F.array_join(days, ","), F.lit(""))

    def capped(cond: Column) -> Column:
        return F.least(F.count_if(cond), F.lit(6)).cast("int")

    n = F.count(F.lit(1))
    filler = F.when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, "-9").otherwise("0")
    return (
        e.groupBy("user_key", F.col("week_date").alias("date"))
        .agg(
            capped(kind == "click").alias("weekly_night_symp"),
            capped(kind == "view").alias("weekly_day_symp"),
            capped(kind == "purchase").alias("weekly_limit_activity"),
            capped(kind == "signup").alias("weekly_short_breath"),
            capped(kind == "error").alias("weekly_wheeze"),
            F.least(F.floor(n / 3), F.lit(6)).cast("int").alias("weekly_relief_inhaler"),
            F.coalesce(offsets((kind == "error") & (k < 5)), filler).alias("weekly_doc"),
            F.coalesce(offsets((kind == "error") & (k == 12)), F.lit("0")).alias("weekly_hospital"),
            offsets((kind == "error") & (k == 14)).alias("weekly_er"),
            (1 + F.least(F.count_if(k >= 97), F.lit(2))).cast("int").alias("weekly_oral"),
        )
    )


def daily(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).filter(F.col("date") >= 0)
    kind, k = F.col("event_type"), F.col("k")
    relief = F.array(*[F.lit(x) for x in (0, 1, 3, 5, 9, 12, 7)])
    codes = F.transform(F.array_sort(F.collect_set(k % 20)), lambda x: x.cast("string"))
    return e.groupBy("user_key", "date").agg(
        F.when(F.count_if(kind == "error") > 0, "True").alias("daily_night_symp"),
        F.when(F.count_if(kind == "view") >= 2, "true").otherwise("False").alias("daily_day_symp"),
        (F.max("value") > 100).alias("daily_limit_activity"),
        (1 + F.max("k") % 5).cast("int").alias("daily_prev_inhaler"),
        F.element_at(relief, (F.sum("k") % 7 + 1).cast("int")).alias("daily_relief_inhaler"),
        F.array_join(codes, ", ").alias("daily_triggers"),
    )


def preds(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(
        F.col("lang").alias("config"),
        F.col("source").alias("user_key"),
        F.col("doc_id").alias("sample_id"),
        F.col("toxic").cast("int").alias("y_true"),
        (F.col("n_chars") % 1000 / 1000.0).alias("y_prob"),
    )


def trials(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")

    def score(mult: int, mod: int) -> Column:
        return (p * mult) % mod / 100.0

    def pick(values: tuple[int, int, int], shift: int) -> Column:
        i = F.floor(p / shift) % 3
        return F.when(i == 0, values[0]).when(i == 1, values[1]).otherwise(values[2]).cast("int")

    return table(spark, d, "part").select(
        p.alias("trial_id"),
        F.lower("p_type").alias("algo"),
        F.col("p_brand").alias("subset"),
        (p % 5).cast("int").alias("seed"),
        pick((2, 3, 4), 1).alias("threshold"),
        pick((7, 14, 28), 3).alias("input_length_days"),
        pick((0, 7, 14), 9).alias("washout_days"),
        score(37, 100).alias("train_pr_auc"),
        F.when(p % 17 != 0, score(53, 97)).alias("val_pr_auc"),
        score(29, 89).alias("val_roc_auc"),
        score(31, 83).alias("val_f1"),
        score(43, 79).alias("val_recall"),
        F.when(p % 11 != 0, score(41, 73)).alias("val_recall_at_precision_floor"),
        score(47, 71).alias("val_precision_at_recall_floor"),
        score(59, 67).alias("val_brier"),
        F.when(p % 13 != 0, score(61, 91)).alias("test_pr_auc"),
        score(67, 93).alias("test_roc_auc"),
        score(71, 87).alias("test_f1"),
        F.col("p_size").cast("int").alias("n_features"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 4).cast("int").alias("param_max_depth"),
        F.when(p % 2 == 0, F.lit("auto")).otherwise((p % 7).cast("string")).alias("param_scale_pos_weight"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Labelled vectors: target 1 for the upper half of the label codes, twelve users."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        (F.col("vec_id") % 12).cast("int").alias("user_key"),
        F.col("label").cast("int").alias("label"),
        (F.col("label") >= 7).cast("int").alias("target"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
