"""Logistic models of all held-out folds at once.

The fits of a cross-validation differ only in the rows that each leaves out. So one pass over the data yields, for a
block of folds together, the penalised loss, gradient and curvature of every fold at its own coefficients, and a
Newton step of all of them follows: one job per step, whatever the number of folds in the block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cohortlake.sources.tables import materialize

BLOCK_VALUES = 2_000_000  # curvature values (doubles) of a block of folds; what a task holds and the driver solves
STEPS = 60
CLOSE = 1e-8  # largest gradient per row at which a fold is done


class Folds:
    """Coefficients of a block of folds in the space of overall standardised features, and their Newton steps."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, total: tuple, c: float, balanced: bool):
        """Per held-out fold its rows of each class (counts), sums and squares of features; ``total`` is all rows'."""
        left = total[0] - counts
        n = left.sum(1)
        self.usable = (left > 0).all(1)
        safe = np.maximum(n, 2.0)[:, None]
        mean = (total[1] - sums) / safe
        deviation = np.maximum(total[2] - squares - safe * mean**2, 0.0) / (safe - 1)
        # A fold scales features by its own training rows, which is a penalty in proportion to their variance here.
        self.flat = deviation < 1e-12
        self.penalty = np.where(self.flat, 1.0, deviation) / c
        weight = n[:, None] / np.maximum(2.0 * left, 1.0) if balanced else np.ones((len(n), 2))
        self.weight = np.where(self.usable[:, None], weight, 0.0)
        self.n = n
        self.at = np.zeros((len(n), sums.shape[1] + 1))  # intercept last
        self.before, self.loss = self.at.copy(), np.full(len(n), np.inf)
        self.gradient = np.full(len(n), np.inf)
        self.open = self.usable.copy()

    def step(self, loss: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> None:
        """Newton step from the values at the present coefficients; a step that raised the loss is halved instead."""
        p = self.penalty.shape[1]
        for k in np.flatnonzero(self.open):
            beta = self.at[k]
            whole = loss[k] + 0.5 * (self.penalty[k] * beta[:p] ** 2).sum()
            if whole > self.loss[k] * (1 + 1e-12) + 1e-12:
                self.at[k] = (beta + self.before[k]) / 2
                continue
            g, h = slope[k].copy(), curve[k].copy()
            g[:p] += self.penalty[k] * beta[:p]
            h[np.arange(p), np.arange(p)] += self.penalty[k]
            fixed = np.flatnonzero(self.flat[k])
            g[fixed], h[fixed], h[:, fixed] = 0.0, 0.0, 0.0
            h[fixed, fixed] = 1.0
            self.before[k], self.loss[k] = beta, whole
            self.gradient[k] = np.abs(g).max() / max(self.n[k], 1)
            if self.gradient[k] <= CLOSE:
                self.open[k] = False
            else:
                self.at[k] = beta - np.linalg.solve(h + 1e-12 * np.eye(p + 1), g)



def _sum_by_fold(parts: DataFrame) -> list:
    """Rows (fold, values) added up per fold. There are at most as many as folds in a block."""

    def add(key, rows):
        import numpy as np
        import pyarrow as pa

        values = rows.column("values").combine_chunks()
        total = values.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).sum(0)
        return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "values": pa.array([total.astype(np.float64)], pa.list_(pa.float64()))})

    return parts.groupBy("fold").applyInArrow(add, "fold int, values array<double>").collect()


def _class_sums(rows: DataFrame, width: int) -> list:
    """Per fold: rows of each class, and sums and sums of squares of the features."""

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fold, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for k in np.unique(fold):
                own = fold == k
                counts = [float((y[own] == 0).sum()), float((y[own] == 1).sum())]
                values = np.concatenate([counts, x[own].sum(0), (x[own] ** 2).sum(0)])
                yield pa.RecordBatch.from_pydict({"fold": pa.array([int(k)], pa.int32()), "values": pa.array([values], pa.list_(pa.float64()))})

    return _sum_by_fold(rows.mapInArrow(sums, "fold int, values array<double>"))


def _derivatives(rows: DataFrame, at: np.ndarray, weight: np.ndarray, first: int, asked: np.ndarray) -> dict[int, np.ndarray]:
    """Per asked fold of the block that begins at ``first``: loss, gradient and curvature over the rows it keeps."""
    width = at.shape[1] - 1

    def values(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((len(asked), 1 + (width + 1) + (width + 1) ** 2))
        for batch in batches:
            fold, y = batch.column("fold").to_numpy() - first, batch.column("y").to_numpy().astype(float)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            for j, k in enumerate(asked):
                w = np.where(y == 1, weight[k, 1], weight[k, 0]) * (fold != k)
                z = x @ at[k]
                p = 0.5 * (1 + np.tanh(z / 2))
                total[j, 0] += (w * (np.logaddexp(0, z) - y * z)).sum()
                total[j, 1 : width + 2] += x.T @ (w * (p - y))
                total[j, width + 2 :] += (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_pydict({"fold": pa.array(asked, pa.int32()), "values": pa.array(list(total), pa.list_(pa.float64()))})

    return {r["fold"]: np.array(r["values"]) for r in _sum_by_fold(rows.mapInArrow(values, "fold int, values array<double>"))}


def _score(rows: DataFrame, at: np.ndarray, usable: np.ndarray, first: int) -> DataFrame:
    """(row_no, y_prob) of the rows that the block's folds hold out, NULL where a fold could not be fitted."""
    width = at.shape[1] - 1

    def score(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fold = batch.column("fold").to_numpy() - first
            own = (fold >= 0) & (fold < len(at))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[own]
            b = at[fold[own]]
            p = 0.5 * (1 + np.tanh(((x * b[:, :width]).sum(1) + b[:, width]) / 2))
            p[~usable[fold[own]]] = np.nan
            yield pa.RecordBatch.from_pydict({"row_no": batch.column("row_no").filter(pa.array(own)), "y_prob": pa.array(p, from_pandas=True)})

    return rows.mapInArrow(score, "row_no bigint, y_prob double")


def blocks(n_folds: int, width: int) -> Iterator[tuple[int, int]]:
    size = max(1, BLOCK_VALUES // (width + 1) ** 2)
    return ((a, min(n_folds, a + size)) for a in range(0, n_folds, size))


def held_out_scores(
    table: DataFrame, features: Sequence[str], fold: str, keep: Sequence[str], target: str, c: float = 1.0, balanced: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores, and a row per fold about its fit.

    ``fold`` names a column; the rows of each of its values are scored by a model of all other rows. Scores have
    ``keep``, y_true and y_prob, fits have fold, gradient (the largest per row, penalty included) and n. Features are
    standardised by each fold's training rows, coefficients have an L2 penalty 1/C and the intercept none. Folds
    whose training rows have one class get NULL scores. Rows without fold or target take no part; features must be
    complete. What a task and the driver hold is bounded by ``BLOCK_VALUES``: more folds are done block after block.
    """
    spark = table.sparkSession
    rows = table.filter(F.col(fold).isNotNull() & F.col(target).isNotNull())
    names = materialize(rows.select(F.col(fold).alias("fold_name")).distinct())
    # Folds are numbered by rank: as many rows as folds.
    listed = [r["fold_name"] for r in names.orderBy("fold_name").toLocalIterator()]
    numbers = spark.createDataFrame(list(enumerate(listed)), f"fold_no int, fold_name {names.dtypes[0][1]}")
    facts = rows.agg(*[F.avg(F.col(f).cast("double")) for f in features], *[F.stddev_samp(F.col(f).cast("double")) for f in features]).first()
    width = len(features)
    scaled = [
        (F.col(f).cast("double") - (facts[k] or 0.0)) / (facts[width + k] if facts[width + k] and facts[width + k] == facts[width + k] else 1.0)
        for k, f in enumerate(features)
    ]
    numbered = rows.join(numbers, rows[fold] == numbers["fold_name"]).select(
        *[F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)], F.col("fold_no").alias("fold"), F.col(target).cast("int").alias("y"), F.array(*scaled).alias("x")
    )
    data = materialize(numbered.withColumn("row_no", F.monotonically_increasing_id()))
    slim = data.select("fold", "y", "x", "row_no")
    sums = np.zeros((len(listed), 2 + 2 * width))
    for r in _class_sums(slim, width):
        sums[r["fold"]] = r["values"]
    total = tuple(np.split(sums.sum(0), [2, 2 + width]))
    scores, fits = [], []
    for first, end in blocks(len(listed), width):
        own = sums[first:end]
        state = Folds(own[:, :2], own[:, 2 : 2 + width], own[:, 2 + width :], total, c, balanced)
        for _ in range(STEPS):
            asked = np.flatnonzero(state.open)
            if not len(asked):
                break
            found = _derivatives(slim, state.at, state.weight, first, asked)
            loss, slope = np.zeros(end - first), np.zeros((end - first, width + 1))
            curve = np.zeros((end - first, width + 1, width + 1))
            for k, v in found.items():
                loss[k], slope[k], curve[k] = v[0], v[1 : width + 2], v[width + 2 :].reshape(width + 1, width + 1)
            state.step(loss, slope, curve)
        else:
            raise RuntimeError(f"no fit of folds {first} to {end - 1} after {STEPS} steps")
        scores.append(_score(slim, state.at, state.usable, first))
        fits += [(listed[first + k], float(state.gradient[k]) if state.usable[k] else None, float(state.n[k])) for k in range(end - first)]
    kind = names.dtypes[0][1]
    about = spark.createDataFrame(fits, f"`{fold}` {kind}, gradient double, n double")
    if not scores:
        return data.select(*[F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)], F.col("y").alias("y_true"), F.lit(None).cast("double").alias("y_prob")), about
    scored = scores[0]
    for s in scores[1:]:
        scored = scored.unionByName(s)
    out = data.drop("x").join(scored, "row_no")
    return out.select(*[F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)], F.col("y").alias("y_true"), "y_prob"), about
