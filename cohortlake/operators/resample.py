"""Bootstrap intervals, label shuffles and permutation tests with a seeded MD5 order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortlake.functions import exprs as E
from cohortlake.operators import ranking, slotdraws, splittree
from cohortlake.operators.ordering import integer_levels, number_by_hash, number_rows
from cohortlake.sources.tables import materialize


def _draws(numbered: DataFrame, keys: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """How often each number 0..size-1 is drawn: (keys, draw, idx, w).

    ``numbered`` carries ``rn`` (1-based) and ``size``. Each row stands for one slot per draw.
    """
    slot = F.col("rn") - 1
    laid = numbered.select(*keys, "size", slot.alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("draw"))
    idx = E.hash_index(seed, F.col("size"), "draw", "slot")
    return laid.groupBy(*keys, "draw", idx.alias("idx")).agg(F.count(F.lit(1)).alias("w"))


def row_bootstrap(preds: DataFrame, keys: Sequence[str], ident: str, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Metrics per (keys, draw) of row-wise resamples. No draw becomes a row, see ``slotdraws``."""
    keys = list(keys)
    sizes = preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    numbered = number_by_hash(preds.select(*keys, ident, "y_true", "y_prob"), keys, [ident], "rows").join(sizes, keys)
    return slotdraws.row_metrics(materialize(numbered), keys, n_boot, seed)


def cluster_bootstrap(preds: DataFrame, keys: Sequence[str], user: str, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Metrics per (keys, draw) when whole users are drawn with replacement."""
    keys = list(keys)
    users = preds.select(*keys, user).distinct()
    sizes = users.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    numbered = number_by_hash(users, keys, [user], "users").join(sizes, keys)
    picked = (
        _draws(numbered, keys, n_boot, seed)
        .join(numbered.select(*keys, (F.col("rn") - 1).alias("idx"), user), [*keys, "idx"])
        .select(*keys, "draw", user, "w")
    )
    rows = (
        preds.groupBy(*keys, user, "y_prob", "y_true").agg(F.count(F.lit(1)).alias("m")).join(picked, [*keys, user])
        .withColumn("weight", F.col("m") * F.col("w"))
    )
    return ranking.auc(rows, [*keys, "draw"], "weight")


def interval(draws: DataFrame, keys: Sequence[str], metrics: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Percentile interval per config over its draws; one-class draws (NULL ROC-AUC) are skipped."""
    used = draws.filter(F.col("roc_auc").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n_draws")]
    for m in metrics:
        aggs += [
            F.percentile(m, alpha / 2).alias(f"{m}_lo"), F.percentile(m, 1 - alpha / 2).alias(f"{m}_hi"),
        ]
    return used.groupBy(*keys).agg(*aggs)


def bootstrap_ci(preds: DataFrame, keys: Sequence[str], ident: str, n_boot: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Point value and percentile interval of both ranking metrics; NULL bounds under 5 rows or one class."""
    return point_and_interval(preds, keys, row_bootstrap(preds, keys, ident, n_boot, seed), alpha)


def tree_bootstrap_ci(preds: DataFrame, keys: Sequence[str], n_boot: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """``bootstrap_ci`` with the draws of ``splittree``: no row per draw, and rows need no id."""
    return point_and_interval(preds, keys, splittree.row_bootstrap(preds, keys, n_boot, seed), alpha)


def point_and_interval(preds: DataFrame, keys: Sequence[str], draws: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Metrics of the predictions beside the percentile interval of their resamples."""
    keys = list(keys)
    metrics = ["roc_auc", "pr_auc"]
    point = ranking.auc(preds, keys)
    ci = interval(draws, keys, metrics, alpha)
    usable = (F.col("n") >= 5) & (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    cols = ["roc_auc", "pr_auc", *[f"{m}_{b}" for m in metrics for b in ("lo", "hi")]]
    return point.join(ci, keys, "left").select(*keys, "n", "pos", *[F.when(usable, F.col(c)).alias(c) for c in cols])


def shuffle_labels(df: DataFrame, within: Sequence[str], ident: str, target: str, seed: int) -> DataFrame:
    """Permute the labels among the rows of each group; everything else stays."""
    within = list(within)
    receiver = number_by_hash(df, within, [ident], "receiver")
    donor = number_by_hash(df.select(*within, ident, target), within, [ident], seed)
    return receiver.join(
        donor.select(*within, "rn", F.col(target).alias(f"{target}_shuffled")), [*within, "rn"]
    ).drop("rn")


def _donors(users: DataFrame, user: str, seed: int, n_perm: int) -> DataFrame:
    """Who gives labels to whom: (perm, user, size, donor, donor_n) from one row per user with its ``size``."""
    laid = users.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    taker = number_by_hash(users, [], [user], "users", "place")
    giver = number_by_hash(laid, ["perm"], ["perm", user], seed, "place")
    return taker.join(
        giver.select("perm", "place", F.col(user).alias("donor"), F.col("size").alias("donor_n")), "place"
    ).drop("place")


def permute_user_blocks(
    df: DataFrame, user: str, order: str, target: str, seed: int, n_perm: int = 1
) -> DataFrame:
    """Give every user the label sequence of another user, position by position, wrapping when it is shorter.

    One copy of the rows per permutation 0..n_perm-1, in column ``perm``. The permutations are drawn on the
    user table, so rows are numbered once whatever their number. ``order`` is a non-negative integer that
    orders the rows of a user uniquely.
    """
    rows = number_rows(df, [user], integer_levels(F.col(order)), [F.col(order)])
    sigma = _donors(df.groupBy(user).agg(F.count(F.lit(1)).alias("size")), user, seed, n_perm).drop("size")
    placed = rows.join(sigma, user).withColumn("pos", (F.col("rn") - 1) % F.col("donor_n") + 1)
    labels = rows.select(F.col(user).alias("donor"), F.col("rn").alias("pos"), F.col(target).alias(f"{target}_perm"))
    return placed.join(labels, ["donor", "pos"]).select("perm", *df.columns, "donor", f"{target}_perm")


CHUNK = 4096  # positions of a user in one packed row


def _packed(df: DataFrame, user: str, order: str, target: str, score: str) -> DataFrame:
    """Blocks of CHUNK positions of a user: ``ranks[slot]`` (twice the rank among all scores, ties averaged, NULL
    without a score) and ``ups``, the slots of the positive labels."""
    at = ranking.cumulative(df.select(F.col(score).alias("y_prob"), F.col(target).alias("y_true")), [])
    twice = at.select(F.col("y_prob").alias(score), (2 * (F.col("n") - F.col("cum_n")) + F.col("n_at") + 1).alias("rank"))
    rows = number_rows(df.select(user, order, target, score), [user], integer_levels(F.col(order)), [F.col(order)])
    place = F.col("rn") - 1
    cell = F.struct((place % CHUNK).cast("smallint").alias("slot"), "rank", (F.col(target) == 1).alias("up"))
    cells = (
        rows.join(twice, score, "left")
        .groupBy(user, F.floor(place / CHUNK).alias("chunk"))
        .agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    )
    return cells.select(
        user, "chunk", F.transform("cells", lambda c: c["rank"]).alias("ranks"),
        F.transform(F.filter("cells", lambda c: c["up"]), lambda c: c["slot"]).alias("ups"),
    )


def permuted_roc(
    df: DataFrame, user: str, order: str, target: str, score: str, seed: int, n_perm: int
) -> DataFrame:
    """ROC-AUC of fixed scores under each permutation of ``permute_user_blocks``: (perm, n, pos, roc_auc).

    The rows are not copied per permutation. Permuting labels leaves the ranks of the scores as they are, so a
    permutation needs only the sum of ranks at the donors' positive positions. Ranks and positive positions are packed
    by blocks of positions; what moves per permutation are the donor's short lists of positive positions.
    Sums are exact. Rows without a score count in no rank; one class gives NULL.
    """
    packed = materialize(_packed(df, user, order, target, score))
    sizes = packed.groupBy(user).agg(F.sum(F.size("ranks")).cast("bigint").alias("size"))
    pairs = _donors(sizes, user, seed, n_perm).groupBy(user, "size", "donor", "donor_n").agg(F.collect_list("perm").alias("perms"))
    base, span = F.col("chunk") * CHUNK, F.col("span")
    start = base % F.col("donor_n")
    last = F.least(start + span, F.col("donor_n")) - 1
    over = F.least(start + span - F.col("donor_n"), F.col("donor_n")) - 1  # last position after wrapping, if any
    block = lambda c: F.floor(c / CHUNK)
    met = F.concat(
        F.sequence(block(start), block(last)), F.when(over >= 0, F.sequence(F.lit(0).cast("bigint"), block(over))).otherwise(F.array().cast("array<bigint>"))
    )
    wanted = (
        pairs.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), block(F.col("size") - 1))))
        .withColumn("span", F.least(F.col("size") - base, F.lit(CHUNK)))
        .withColumn("donor_chunk", F.explode(F.array_distinct(met)))
    )
    ups = packed.filter(F.size("ups") > 0).select(F.col(user).alias("donor"), F.col("chunk").alias("donor_chunk"), "ups")
    labelled = wanted.join(ups, ["donor", "donor_chunk"]).join(packed.select(user, "chunk", "ranks"), [user, "chunk"])

    def hits(slot):
        first = F.pmod(F.col("donor_chunk") * CHUNK + slot - base, F.col("donor_n"))
        return F.when(first < span, F.sequence(first, span - 1, F.col("donor_n"))).otherwise(F.array().cast("array<bigint>"))

    found = F.filter(
        F.transform(F.flatten(F.transform("ups", hits)), lambda i: F.get("ranks", i.cast("int"))), lambda r: r.isNotNull()
    )
    part = labelled.select(user, "donor", "perms", found.alias("found")).select(
        user, "donor", "perms", F.size("found").alias("p"),
        F.aggregate("found", F.lit(0).cast("bigint"), lambda a, r: a + r).cast("decimal(38,0)").alias("r"),
    )
    summed = part.groupBy(user, "donor", "perms").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    by_perm = (
        summed.select(F.explode("perms").alias("perm"), "p", "r").groupBy("perm")
        .agg(F.sum("p").cast("bigint").alias("pos"), F.sum("r").alias("ranks"))
    )
    scored = F.size(F.filter("ranks", lambda r: r.isNotNull()))
    every = packed.agg(F.sum(scored).cast("bigint").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    wide = pos.cast("decimal(19,0)")
    return (
        every.join(by_perm, "perm", "left")
        .withColumn("pos", F.coalesce("pos", F.lit(0)))
        .select(
            "perm", "n", "pos",
            F.when(
                (pos > 0) & (neg > 0),
                (F.col("ranks") - wide * (wide + 1)).cast("double") / (2.0 * pos.cast("double") * neg.cast("double")),
            ).alias("roc_auc"),
        )
    )


def permutation_summary(null: DataFrame, real: DataFrame, config: str = "config", metric: str = "roc_auc") -> DataFrame:
    """Null distribution per config and p = (draws at least as good + 1) / (draws + 1)."""
    value, point = F.col(metric), F.col("real_value")
    joined = null.filter(value.isNotNull()).join(real.select(config, F.col(metric).alias("real_value")), config)
    return joined.groupBy(config, "real_value").agg(
        F.count(value).alias("null_n"),
        F.avg(value).alias("null_mean"),
        F.stddev_samp(value).alias("null_std"),
        F.percentile(metric, 0.05).alias("null_q05"),
        F.percentile(metric, 0.50).alias("null_q50"),
        F.percentile(metric, 0.95).alias("null_q95"),
        F.when(point.isNotNull(), (F.count_if(value >= point) + 1) / (F.count(value) + 1)).alias("p_value"),
    )
