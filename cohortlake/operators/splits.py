"""User-disjoint splits. The random order of users is their seeded MD5, so every engine agrees on it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from cohortlake.functions import exprs as E
from cohortlake.operators.ordering import number_by_hash, number_rows
from cohortlake.sources.tables import materialize

USER = "user_key"


def _users(df: DataFrame, user: str) -> DataFrame:
    """Distinct users, written once: the source may be a long job, and the split reads them several times."""
    return materialize(df.select(user).filter(F.col(user).isNotNull()).distinct())


def three_way_split(
    df: DataFrame, seed: int = 42, val_frac: float = 0.15, test_frac: float = 0.20, user: str = USER
) -> DataFrame:
    """(user, split): the first ceil(n*test) users are test, the next ceil(n*val) val, the rest train."""
    if not (0 < val_frac < 1 and 0 < test_frac < 1 and val_frac + test_frac < 1):
        raise ValueError("fractions must lie in (0, 1) and sum to less than 1")
    users = _users(df, user)
    n = users.count()
    if n < 3:
        raise ValueError(f"need at least 3 users for a 3-way split, got {n}")
    n_test = max(1, math.ceil(n * test_frac))
    n_val = max(1, math.ceil(n * val_frac))
    if n_test + n_val >= n:
        n_val = max(1, n - n_test - 1)
    ranked = number_by_hash(users, [], [user], seed)
    split = F.when(F.col("rn") <= n_test, "test").when(F.col("rn") <= n_test + n_val, "val").otherwise("train")
    return ranked.select(user, split.alias("split"))


def two_way_split(df: DataFrame, seed: int = 42, test_size: float = 0.25, user: str = USER, held: str = "test", rest: str = "train") -> DataFrame:
    users = _users(df, user)
    n_test = math.ceil(users.count() * test_size)
    ranked = number_by_hash(users, [], [user], seed)
    return ranked.select(user, F.when(F.col("rn") <= n_test, held).otherwise(rest).alias("split"))


def nested_split(df: DataFrame, seed: int = 42, test_size: float = 0.25, val_size: float = 0.20, user: str = USER) -> DataFrame:
    """Outer test split, then a validation split of the remaining users with the next seed."""
    outer = materialize(two_way_split(df, seed, test_size, user))
    test = outer.filter(F.col("split") == "test")
    inner = two_way_split(outer.filter(F.col("split") == "train"), seed + 1, val_size, user, held="val")
    return test.unionByName(inner)


def _best_trial(stats: DataFrame, k: int, overall: float, n_trials: int, seed: str, user: str) -> DataFrame:
    """Users held out by the trial whose weighted positive rate is closest to the overall one."""
    laid = stats.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1))))
    h = E.hash_order(seed, "trial", user)
    ranked = number_rows(laid, ["trial"], [F.substring(h, 1, 5)], [h, F.col(user)])
    held = ranked.filter(F.col("rn") <= k)
    gap = F.abs(F.sum("pos") / F.sum("n") - overall)
    gaps = held.groupBy("trial").agg(F.round(gap, 12).alias("gap"))
    best = gaps.agg(F.min(F.struct("gap", "trial"))["trial"]).first()[0]
    return materialize(held.filter(F.col("trial") == best).select(user))


def stratified_split(
    df: DataFrame, target: str, seed: int = 42, test_size: float = 0.25, val_size: float = 0.20, n_trials: int = 64, user: str = USER
) -> DataFrame:
    """Best of ``n_trials`` random user splits by the gap of the positive rate, outer and then inner."""
    stats = materialize(df.groupBy(user).agg(F.sum(target).alias("pos"), F.count(F.lit(1)).alias("n")))
    overall, n = stats.agg(F.sum("pos") / F.sum("n"), F.count(F.lit(1))).first()
    k_test = max(2, round(test_size * n))
    test = _best_trial(stats, k_test, overall, n_trials, f"{seed}:outer", user)
    rest = stats.join(test, user, "left_anti")
    k_val = max(1, round(val_size * (n - k_test)))
    val = _best_trial(rest, k_val, overall, n_trials, f"{seed}:inner", user)
    return (
        stats.select(user)
        .join(test.withColumn("is_test", F.lit(True)), user, "left")
        .join(val.withColumn("is_val", F.lit(True)), user, "left")
        .select(user, F.when(F.col("is_test"), "test").when(F.col("is_val"), "val").otherwise("train").alias("split"))
    )


def group_folds(df: DataFrame, n_splits: int = 5, user: str = USER) -> DataFrame:
    """Users dealt to folds in snake order of their size, so that folds stay close in rows.

    The greedy lightest-fold rule is sequential; dealing needs ranks only.
    """
    sizes = df.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    h = E.hash_order("fold", user)
    ranked = number_rows(sizes, [], [-F.col("n"), F.substring(h, 1, 5)], [h, F.col(user)])
    lap = F.floor((F.col("rn") - 1) / n_splits)
    place = (F.col("rn") - 1) % n_splits
    fold = F.when(lap % 2 == 0, place).otherwise(n_splits - 1 - place)
    return ranked.select(user, "n", fold.cast("int").alias("fold"))


def leave_one_out(df: DataFrame, user: str = USER) -> DataFrame:
    """Fold table: one row per held-out user, with train and test sizes."""
    sizes = df.groupBy(user).agg(F.count(F.lit(1)).alias("n_test"))
    total = sizes.agg(F.sum("n_test")).scalar()
    return sizes.select(F.col(user).alias("held_out_user"), "n_test", (total - F.col("n_test")).alias("n_train"))


def apply_split(df: DataFrame, split: DataFrame, user: str = USER) -> DataFrame:
    """Attach the split name; rows of users outside the split drop out."""
    return df.join(split.select(user, "split"), user)


def overlap(a: DataFrame, b: DataFrame, user: str = USER) -> DataFrame:
    """Users in both sides; must be empty for disjoint splits."""
    return a.select(user).intersect(b.select(user))
