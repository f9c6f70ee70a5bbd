"""Model jobs on MLlib. Every fit and every score is distributed.

A job over many fits appends each fit's scores to one table and computes all metrics from that table at the end, so
its plans stay as small as one fit's. Given a folder, a job that was stopped goes on with the fits that are missing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, ImputerModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.functions import exprs as E
from cohortlake.operators import ranking, resample, splits
from cohortlake.operators.select import best_trials, diagnostics
from cohortlake.plans import folds
from cohortlake.sources.tables import materialize, path_exists, scratch_dir

USER, TARGET = "user_key", "target"
ALGOS = ["lr", "rf", "gbt"]


class CannotFit(ValueError):
    """The training rows have one class only or no usable feature."""


class ScoreTable:
    """Scores of many fits in one table on shared storage, one folder per fit."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path, self.any = spark, path or f"{scratch_dir(spark)}/scores", False

    def _folder(self, labels: dict) -> str:
        name = hashlib.sha256(repr(sorted(labels.items())).encode()).hexdigest()[:24]
        return f"{self.path}/fit={name}"

    def has(self, **labels) -> bool:
        """Whether this fit's scores were written whole."""
        done = path_exists(self.spark, f"{self._folder(labels)}/_SUCCESS")
        self.any |= done
        return done

    def add(self, scored: DataFrame, **labels) -> None:
        _tag(scored, **labels).write.mode("overwrite").parquet(self._folder(labels))
        self.any = True

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/fit=*").drop("fit")


def tree_depth(depth: int | None) -> int:
    """MLlib grows trees to 30 levels at most; no limit asked for means these 30, a deeper one is an error."""
    if depth is not None and depth > 30:
        raise ValueError(f"trees of depth {depth} are asked for; 30 is the most that can be grown")
    return 30 if depth is None else depth


def training_facts(train: DataFrame, cols: Sequence[str]) -> tuple[int, int, list[str]]:
    """Positives, negatives and the columns with any training value, from one aggregate row."""
    target = F.col(TARGET)
    row = train.agg(F.count_if(target == 1), F.count_if(target == 0), *[F.count(c) for c in cols]).first()
    return int(row[0]), int(row[1]), [c for c, n in zip(cols, row[2:]) if n > 0]


def estimator(algo: str, params: dict, n_rows: int, weighted: bool, seed: int):
    common = {"labelCol": TARGET, "featuresCol": "features"} | ({"weightCol": "_w"} if weighted else {})
    if algo == "lr":
        return LogisticRegression(
            regParam=1.0 / (params.get("C", 1.0) * max(n_rows, 1)), maxIter=params.get("max_iter", 100),
            standardization=False, **common,
        )
    if algo == "rf":
        return RandomForestClassifier(
            numTrees=params.get("n_estimators", 300), maxDepth=tree_depth(params.get("max_depth")),
            minInstancesPerNode=params.get("min_samples_leaf", 1), seed=seed, **common,
        )
    if algo == "gbt":
        return GBTClassifier(
            maxIter=params.get("n_estimators", 250), maxDepth=params.get("max_depth", 3),
            stepSize=params.get("learning_rate", 0.05), subsamplingRate=params.get("subsample", 0.8),
            featureSubsetStrategy=str(params.get("colsample_bytree", 0.8)), seed=seed, **common,
        )
    raise ValueError(f"unknown algorithm {algo}")


def medians(train: DataFrame, features: Sequence[str]) -> tuple[int, int, list[str], ImputerModel]:
    """Positives, negatives, usable columns and the exact medians that fill them: what fits on the same training rows share."""
    n_pos, n_neg, cols = training_facts(train, features)
    if not (n_pos and n_neg and cols):
        raise CannotFit(f"{n_pos} positives, {n_neg} negatives and {len(cols)} usable features")
    imputer = Imputer(strategy="median", relativeError=0.0, inputCols=cols, outputCols=[f"{c}_f" for c in cols])  # exact
    return n_pos, n_neg, cols, imputer.fit(train.select(*[F.col(c).cast("double").alias(c) for c in cols]))


def fit(
    train: DataFrame, features: Sequence[str], algo: str, params: dict | None = None, seed: int = 42,
    shared: tuple[int, int, list[str], ImputerModel] | None = None,
) -> PipelineModel:
    """Median imputation, assembly, scaling for the linear model, then the classifier.

    ``shared`` are the ``medians`` of these training rows and features, where several fits use them.
    """
    params = params or {}
    n_pos, n_neg, cols, imputer = shared or medians(train, features)
    weight = _weights(algo, params, n_pos, n_neg)
    data = train.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(TARGET).cast("double").alias(TARGET))
    if weight is not None:
        data = data.withColumn("_w", weight)
    filled = [f"{c}_f" for c in cols]
    stages = [imputer]
    if algo == "lr":
        stages += [
            VectorAssembler(inputCols=filled, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        ]
    else:
        stages.append(VectorAssembler(inputCols=filled, outputCol="features"))
    stages.append(estimator(algo, params, n_pos + n_neg, weight is not None, seed))
    model = Pipeline(stages=stages).fit(data)
    model.feature_names = cols
    return model


def _weights(algo: str, params: dict, n_pos: int, n_neg: int) -> Column | None:
    n = n_pos + n_neg
    positive = F.col(TARGET) == 1
    if algo == "gbt":
        mode = params.get("scale_pos_weight", "auto")
        return F.when(positive, (n_neg / n_pos if n_pos else 1.0) if mode == "auto" else float(mode)).otherwise(1.0)
    if params.get("class_weight") == "balanced" and n_pos and n_neg:
        return F.when(positive, n / (2 * n_pos)).otherwise(n / (2 * n_neg))
    return None


def beats_constant(model: PipelineModel, train: DataFrame, algo: str, params: dict | None = None) -> bool:
    """Whether the weighted log-loss on training rows is below that of the best constant score."""
    n_pos, n_neg, _ = training_facts(train, [])
    weight = _weights(algo, params or {}, n_pos, n_neg)
    rows = score(model, train, []).withColumnRenamed("y_true", TARGET)
    p = F.greatest(F.least("y_prob", F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = -F.log(F.when(F.col(TARGET) == 1, p).otherwise(1 - p))
    w = F.lit(1.0) if weight is None else weight
    total, pos, neg = rows.agg(F.sum(w * loss), F.sum(F.when(F.col(TARGET) == 1, w)), F.sum(F.when(F.col(TARGET) == 0, w))).first()
    rate = pos / (pos + neg)
    return bool(total < -(pos * math.log(rate) + neg * math.log(1 - rate)))


def gradient(model: PipelineModel, train: DataFrame, params: dict | None = None) -> float:
    """Largest derivative per row of a logistic model's penalised loss at its coefficients; near zero after a right fit."""
    params = params or {}
    n_pos, n_neg, _ = training_facts(train, [])
    weight = _weights("lr", params, n_pos, n_neg)
    fitted = model.stages[-1]
    data = model.transform(train.select(*[F.col(c).cast("double").alias(c) for c in model.feature_names], TARGET))
    off = (F.lit(1.0) if weight is None else weight) * (vector_to_array("probability")[1] - F.col(TARGET))
    x = vector_to_array("features")
    sums = data.select(off.alias("off"), x.alias("x")).agg(F.sum("off"), *[F.sum(F.col("off") * F.get("x", F.lit(k))) for k in range(fitted.numFeatures)]).first()
    slopes = [s + b / params.get("C", 1.0) for s, b in zip(sums[1:], fitted.coefficients)]
    return max(abs(v) for v in [sums[0], *slopes]) / (n_pos + n_neg)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    cols = model.feature_names
    data = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols if c not in keep], TARGET)
    return model.transform(data).select(
        *keep, F.col(TARGET).cast("int").alias("y_true"), vector_to_array("probability")[1].alias("y_prob")
    )


def majority_baseline(train: DataFrame, test: DataFrame, target: str = TARGET) -> DataFrame:
    """Predict the most frequent training class; the smaller label wins a tie."""
    counts = train.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    label = counts.agg(F.max_by(target, F.struct("n", -F.col(target)))).scalar()
    return test.withColumn("y_pred", label)


def platt(val: DataFrame, other: DataFrame) -> DataFrame:
    """Calibrate ``y_prob`` of ``other`` by a one-feature logistic fit on validation scores."""
    n = val.count()
    assembler = VectorAssembler(inputCols=["y_prob"], outputCol="features")
    lr = LogisticRegression(labelCol="y_true", featuresCol="features", regParam=1.0 / max(n, 1), standardization=False)
    model = lr.fit(assembler.transform(val.select("y_prob", F.col("y_true").cast("double").alias("y_true"))))
    out = model.transform(assembler.transform(other))
    return out.withColumn("y_cal", vector_to_array("probability")[1]).select(*other.columns, "y_cal")


def ensemble(preds: DataFrame, ident: Sequence[str], model: str, weights: dict[str, float] | DataFrame) -> DataFrame:
    """Weighted mean of the models' scores per sample. ``weights`` is a dict or a table (model, weight)."""
    if isinstance(weights, dict):
        rows = preds.withColumn("weight", E.lookup(F.col(model), weights)).filter(F.col("weight").isNotNull())
    else:
        rows = preds.join(weights, model)
    return rows.groupBy(*ident).agg(
        F.first("y_true").alias("y_true"),
        (F.sum(F.col("weight") * F.col("y_prob")) / F.sum("weight")).alias("y_prob"),
    )


def auc_weights(val_preds: DataFrame, model: str) -> DataFrame:
    """Weight of each model: its validation ROC-AUC, at least 0.5."""
    return ranking.auc(val_preds, [model]).select(model, F.greatest(F.coalesce("roc_auc", F.lit(0.5)), F.lit(0.5)).alias("weight"))


def importances(model: PipelineModel, spark, top: int = 15) -> DataFrame:
    """Largest feature importances of a tree model; one number per feature, so bounded by the table's width."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(model.feature_names, values)]
    table = spark.createDataFrame(rows, "feature STRING, importance DOUBLE")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def _tag(df: DataFrame, **labels) -> DataFrame:
    return df.select(*[F.lit(v).alias(k) for k, v in labels.items()], "*")


SPLITS = ["train", "val", "test"]


def _wide_metrics(preds: DataFrame, keys: Sequence[str], names: Sequence[str] = SPLITS) -> DataFrame:
    """One row per config: ``<split>_<metric>``, both floors, and the panel at the threshold tuned on validation.

    The tuned columns are ``tuned_threshold`` and ``<split>_tuned_<metric>``; without validation rows they are NULL.
    """
    keys = list(keys)
    by_split = [*keys, "split"]
    rows = ranking.panel(preds, by_split)
    rows = rows.join(ranking.recall_at_precision(preds, by_split).drop("score_cut"), by_split, "left")
    rows = rows.join(ranking.precision_at_recall(preds, by_split).drop("score_cut"), by_split, "left")
    cuts = ranking.best_f1_threshold(preds.filter("split = 'val'"), keys).select(*keys, F.col("score_cut").alias("tuned_threshold"))
    tuned = ranking.confusion(preds.join(cuts, keys), by_split, F.col("tuned_threshold"))
    rates = ["f1", "precision", "recall", "accuracy"]
    rows = rows.join(tuned.select(*by_split, *[F.col(c).alias(f"tuned_{c}") for c in rates]), by_split, "left")
    metrics = ["n", "pos", *ranking.PANEL, "recall_at_precision_floor", "precision_at_recall_floor", *[f"tuned_{c}" for c in rates]]
    wide = rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for s in names for m in metrics]
    )
    return wide.join(cuts, keys, "left")


def param_grid(options: dict[str, dict[str, list]]) -> list[tuple[str, dict]]:
    out = []
    for algo, choices in options.items():
        out += [(algo, dict(zip(choices, values))) for values in product(*choices.values())]
    return out


def params_text(params: dict) -> str:
    return ";".join(f"{k}={params[k]}" for k in sorted(params))


def sweep(
    table: DataFrame,
    split: DataFrame,
    features: Sequence[str],
    cell_keys: Sequence[str],
    trials: Sequence[tuple[str, dict]],
    seed: int = 42,
    path: str | None = None,
) -> DataFrame:
    """Trial table over grid cells and parameters, as ``select.best_trials`` reads it. Test rows are never scored.

    Cells with one training class or no validation positive are skipped. A trial that cannot be fitted, because its
    features are all empty, keeps its row with NULL metrics; any other failure is raised. ``trial_id`` numbers the
    trials in order of cells and parameters. With ``path`` a stopped sweep goes on where it was.
    """
    spark = table.sparkSession
    data = materialize(splits.apply_split(table, split).filter("split <> 'test'"))
    train = F.col("split") == "train"
    counts = data.groupBy(*cell_keys).agg(
        F.count_if(train & (F.col(TARGET) == 1)).alias("tp"),
        F.count_if(train & (F.col(TARGET) == 0)).alias("tn"),
        F.count_if((F.col("split") == "val") & (F.col(TARGET) == 1)).alias("vp"),
    )
    usable = materialize(counts.filter("tp > 0 and tn > 0 and vp > 0"))
    table_of, tried = ScoreTable(spark, path), []
    keys = [*cell_keys, "algo", "params"]
    for cell in usable.orderBy(*cell_keys).toLocalIterator():
        part, shared = data.filter(reduce(lambda a, b: a & b, [F.col(k) == cell[k] for k in cell_keys])), None
        for algo, params in trials:
            labels = {k: cell[k] for k in cell_keys} | {"algo": algo, "params": params_text(params)}
            tried.append((len(tried), *[labels[k] for k in keys]))
            if table_of.has(**labels):
                continue
            try:
                shared = shared or medians(part.filter(train), features)
                model = fit(part.filter(train), features, algo, params, seed, shared)
            except CannotFit:
                continue
            scored = score(model, part, [USER, "split"]).withColumn("n_features", F.lit(len(model.feature_names)))
            table_of.add(scored, **labels)
    if not tried:
        raise ValueError("no grid cell has both training classes and a validation positive")
    kinds = dict(table.dtypes)
    schema = ", ".join(["trial_id bigint", *[f"{k} {kinds.get(k, 'string')}" for k in keys]])
    spine = spark.createDataFrame(tried, schema)
    if not table_of.any:
        return spine
    preds = table_of.read()
    width = preds.groupBy(*keys).agg(F.first("n_features").alias("n_features"))
    metrics = _wide_metrics(preds, keys, SPLITS[:2]).join(width, keys)
    return diagnostics(spine.join(metrics, keys, "left"))


def train_test_table(table: DataFrame, features: Sequence[str], models: Sequence[tuple[str, dict]], seed: int = 42) -> DataFrame:
    """Metrics and sizes of several models under one user-disjoint train/test split."""
    data = materialize(splits.apply_split(table, splits.two_way_split(table, seed)))
    scores = ScoreTable(table.sparkSession)
    for algo, params in models:
        model = fit(data.filter(F.col("split") == "train"), features, algo, params, seed)
        scores.add(score(model, data, [USER, "split"]), algo=algo)
    return _wide_metrics(scores.read(), ["algo"], ["train", "test"])


def refit_and_test(table: DataFrame, split: DataFrame, features: Sequence[str], winners: Sequence[tuple[str, dict]], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Final test of chosen models, and its test scores.

    Test columns are those of a fit on train and validation rows. Train and validation columns, both floors and the
    tuned threshold are those of a fit on training rows alone, as in tuning; gaps and flags come from both.
    """
    spark = table.sparkSession
    data = materialize(splits.apply_split(table, split))
    scores = ScoreTable(spark)
    for algo, params in winners:
        final = fit(data.filter(F.col("split") != "test"), features, algo, params, seed)
        scores.add(score(final, data.filter(F.col("split") == "test"), [USER, "sample_id", "split"]), algo=algo, part="final")
        first = fit(data.filter(F.col("split") == "train"), features, algo, params, seed)
        scores.add(score(first, data.filter(F.col("split") != "test"), [USER, "sample_id", "split"]), algo=algo, part="tuning")
    preds = scores.read()
    # Each split's rows come from one fit alone, so the wide metrics read both parts at once.
    result = diagnostics(_wide_metrics(preds.drop("part"), ["algo"]))
    return result, preds.filter("part = 'final'").drop("part", "split")


def tune_and_test(
    table: DataFrame, split: DataFrame, features: Sequence[str], cell_keys: Sequence[str], trials: Sequence[tuple[str, dict]], seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """From a sweep to the rows of a headline: trials, and the final row of each algorithm's best trial."""
    spark = table.sparkSession
    swept = materialize(sweep(table, split, features, cell_keys, trials, seed))
    best = best_trials(swept.filter("val_pr_auc is not null"), ["algo"])
    by_text = {(algo, params_text(params)): params for algo, params in trials}
    parts = []
    for win in best.orderBy("algo").collect():  # one row per algorithm of the caller's list
        cell = reduce(lambda a, b: a & b, [F.col(k) == win[k] for k in cell_keys])
        row, _ = refit_and_test(table.filter(cell), split, features, [(win["algo"], by_text[win["algo"], win["params"]])], seed)
        labels = {k: win[k] for k in [*cell_keys, "trial_id", "n_features"]}
        parts.append(materialize(row.select("*", *[F.lit(v).alias(k) for k, v in labels.items()])))
    if not parts:
        return swept, spark.createDataFrame([], swept.schema)
    return swept, reduce(lambda a, b: a.unionByName(b), parts)


def ablation(table: DataFrame, split: DataFrame, subsets: dict[str, Sequence[str]], algo: str, params: dict, seed: int = 42) -> DataFrame:
    """Same model and parameters on several column subsets of one wide table."""
    data = materialize(splits.apply_split(table, split))
    scores = ScoreTable(table.sparkSession)
    for name, cols in subsets.items():
        model = fit(data.filter(F.col("split") == "train"), cols, algo, params, seed)
        scores.add(score(model, data, [USER, "split"]), subset=name, n_features=len(model.feature_names))
    return _wide_metrics(scores.read(), ["subset", "n_features"])


def leakage_probe(table: DataFrame, split: DataFrame, features: Sequence[str], algo: str, params: dict, shuffles: int = 5, seed: int = 42) -> DataFrame:
    """Validation metrics after shuffling the labels inside each split; should hover around chance."""
    data = materialize(splits.apply_split(table, split))
    scores = ScoreTable(table.sparkSession)
    for i in range(shuffles):
        mixed = resample.shuffle_labels(data, ["split"], "sample_id", TARGET, seed + i)
        mixed = materialize(mixed.withColumn(TARGET, F.col(f"{TARGET}_shuffled")))
        model = fit(mixed.filter(F.col("split") == "train"), features, algo, params, seed)
        scores.add(score(model, mixed.filter(F.col("split") == "val"), [USER]), shuffle=i)
    return ranking.panel(scores.read(), ["shuffle"])


def probe_gate(summary: DataFrame, value: str = "val_roc_auc_mean", tolerance: float = 0.05) -> DataFrame:
    """Advisory gate: configs whose shuffled-label mean strays from 0.5 are marked, never dropped."""
    return summary.withColumn("gate_passed", F.abs(F.col(value) - 0.5) <= tolerance)


def complete(table: DataFrame, features: Sequence[str]) -> bool:
    """Whether no feature has a missing value, so that there is nothing to impute."""
    row = table.agg(F.count(F.lit(1)), *[F.count(c) for c in features]).first()
    return all(n == row[0] for n in row[1:])


def linear_folds(table: DataFrame, features: Sequence[str], fold: str, keep: Sequence[str], params: dict) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores and fits of logistic models over all values of ``fold`` at once."""
    balanced = params.get("class_weight") == "balanced"
    return folds.held_out_scores(table, features, fold, keep, TARGET, params.get("C", 1.0), balanced)


def lopo(
    table: DataFrame, features: Sequence[str], algo: str, params: dict, seed: int = 42, user: str = USER, path: str | None = None
) -> DataFrame:
    """Out-of-fold predictions, one fit per held-out user. One-class training folds give NULL scores.

    Users are walked one by one, however many there are, and each fold's scores are appended to a table. Class
    counts of all folds come from one grouping, by subtraction. With ``path`` a stopped run goes on where it was.
    """
    data = materialize(table)
    target = F.col(TARGET)
    counts = materialize(data.groupBy(user).agg(F.count_if(target == 1).alias("pos"), F.count_if(target == 0).alias("neg")))
    total = counts.agg(F.sum("pos"), F.sum("neg")).first()
    scores = ScoreTable(table.sparkSession, path)
    for held, pos, neg in counts.orderBy(user).toLocalIterator():
        if scores.has(held=str(held)):
            continue
        train, test = data.filter(F.col(user) != held), data.filter(F.col(user) == held)
        if total[0] == pos or total[1] == neg:
            blank = F.lit(None).cast("double").alias("y_prob")
            scored = test.select(user, "sample_id", target.cast("int").alias("y_true"), blank)
        else:
            scored = score(fit(train, features, algo, params, seed), test, [user, "sample_id"])
        scores.add(scored, held=str(held))
    return scores.read().drop("held")


def out_of_fold(table: DataFrame, features: Sequence[str], algo: str, params: dict, seed: int = 42, user: str = USER) -> DataFrame:
    """``lopo``'s predictions; logistic models on complete features are fitted for all users at once, see ``folds``."""
    data = materialize(table)
    if algo == "lr" and complete(data, features):
        return linear_folds(data, features, user, [user, "sample_id"], params)[0]
    return lopo(data, features, algo, params, seed, user)


def permuted_null(oof: DataFrame, n_perm: int, ident: str = "sample_id", user: str = USER, seed: int = 0) -> DataFrame:
    """Pooled metrics of fixed out-of-fold scores against permuted label blocks, one row per permutation."""
    mixed = resample.permute_user_blocks(materialize(oof), user, ident, "y_true", seed, n_perm)
    return ranking.auc(mixed.select("perm", F.col("y_true_perm").alias("y_true"), "y_prob"), ["perm"])


def permuted_lopo(table: DataFrame, features: Sequence[str], algo: str, params: dict, n_perm: int, seed: int = 0) -> DataFrame:
    """Pooled metrics of full leave-one-user-out runs on permuted label blocks."""
    mixed = materialize(resample.permute_user_blocks(table, USER, "sample_id", TARGET, seed, n_perm))
    mixed = mixed.withColumn(TARGET, F.col(f"{TARGET}_perm"))
    scores = ScoreTable(table.sparkSession)
    for i in range(n_perm):
        scores.add(out_of_fold(mixed.filter(F.col("perm") == i), features, algo, params), perm=i)
    return ranking.auc(scores.read(), ["perm"])


def stack(table: DataFrame, features: Sequence[str], bases: Sequence[tuple[str, dict]], seed: int = 42) -> DataFrame:
    """Calibrated base models combined by a logistic model that is fitted on their validation scores."""
    data = materialize(splits.apply_split(table, splits.nested_split(table, seed)))
    vals, tests = ScoreTable(table.sparkSession), ScoreTable(table.sparkSession)
    keep = [USER, "sample_id"]
    for algo, params in bases:
        model = fit(data.filter(F.col("split") == "train"), features, algo, params, seed)
        val = score(model, data.filter(F.col("split") == "val"), keep)
        test = score(model, data.filter(F.col("split") == "test"), keep)
        vals.add(platt(val, val), model=algo)
        tests.add(platt(val, test), model=algo)
    names = [a for a, _ in bases]

    def wide(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keep, F.col("y_true").alias(TARGET)).pivot("model", names).agg(F.first("y_cal"))

    meta = fit(materialize(wide(vals.read())), names, "lr", {}, seed)
    stacked = score(meta, wide(tests.read()), keep)
    base = tests.read().select("model", *keep, "y_true", F.col("y_cal").alias("y_prob"))
    return base.unionByName(_tag(stacked, model="stack").select("model", *keep, "y_true", "y_prob"))


def panel_runs(
    table: DataFrame, subsets: dict[str, Sequence[str]], models: Sequence[tuple[str, dict]], seeds: Sequence[int],
    n_boot: int = 200,
) -> DataFrame:
    """Models x column subsets x seeds: calibrated test metrics with a user-bootstrap interval."""
    scores = ScoreTable(table.sparkSession)
    for seed in seeds:
        data = materialize(splits.apply_split(table, splits.nested_split(table, seed)))
        for name, cols in subsets.items():
            for algo, params in models:
                model = fit(data.filter(F.col("split") == "train"), cols, algo, params, seed)
                val = score(model, data.filter(F.col("split") == "val"), [USER])
                test = score(model, data.filter(F.col("split") == "test"), [USER])
                cal = platt(val, test).withColumn("y_prob", F.col("y_cal")).drop("y_cal")
                scores.add(cal, model=algo, subset=name, seed=seed)
    keys = ["model", "subset", "seed"]
    preds = scores.read()
    draws = resample.cluster_bootstrap(preds, keys, USER, n_boot)
    ci = resample.interval(draws, keys, ["roc_auc"]).select(
        *keys, F.col("roc_auc_lo").alias("auc_ci_lo"), F.col("roc_auc_hi").alias("auc_ci_hi")
    )
    return ranking.panel(preds, keys).join(ci, keys, "left")


def grouped_cv(table: DataFrame, features: Sequence[str], models: Sequence[tuple[str, dict]], n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Metrics per fold of user-grouped cross-validation."""
    data = materialize(table.join(splits.group_folds(table, n_splits).select(USER, "fold"), USER))
    held = data.groupBy("fold").agg(F.count_if(F.col(TARGET) == 1).alias("pos"), F.count_if(F.col(TARGET) == 0).alias("neg")).collect()  # one row per fold
    pos, neg = sum(r["pos"] for r in held), sum(r["neg"] for r in held)
    scores = ScoreTable(table.sparkSession)
    for algo, params in models:
        if algo == "lr" and complete(data, features):
            found, _ = linear_folds(data, features, "fold", [USER, "fold"], params)
            scores.add(found.filter("y_prob IS NOT NULL"), algo=algo, part=-1)
            continue
        for k, own_pos, own_neg in sorted((r["fold"], r["pos"], r["neg"]) for r in held):
            if pos > own_pos and neg > own_neg:
                model = fit(data.filter(F.col("fold") != k), features, algo, params, seed)
                scores.add(score(model, data.filter(F.col("fold") == k), [USER, "fold"]), algo=algo, part=k)
    return ranking.panel(scores.read(), ["algo", "fold"])
