"""Toxicity: classifiers learnt from confirmed toxic examples and unlabelled text only.

The negative class is never seen. Its risk is that of unlabelled text less the share that toxic text contributes,
which the class prior tells; where this estimate falls below zero on a batch, the step pushes it back up instead of
following it down (non-negative positive-unlabelled learning).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.llm import common, sparse

BITS = 18
POSITIVE_ROWS = 6_000  # most confirmed toxic documents that are learnt from
UNLABELLED_ROWS = 18_000  # most unlabelled documents that are learnt from
LEAST_ROWS = 8  # sampled documents that must hold a word for it to have a weight
APART = 6.0  # standard errors by which a word's shares of toxic and of unlabelled texts must differ for it
MODELS = 3  # averaged; each sees other batches
STEPS = 800
RIDGE = 0.08  # pull of the calibration towards leaving scores as they are
BATCH = 4096
RATE = 0.05
DECAY = 2e-5
THRESHOLD = 0.7


def _buckets(text: object, buckets: sparse.Buckets) -> np.ndarray:
    return np.unique(buckets.of(text if isinstance(text, str) else ""))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    buckets = sparse.Buckets(BITS)
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "positive": batch["positive"], "index": [_buckets(t, buckets) for t in batch["text"]]})


class Classifier:
    """Averaged linear models over the presence of hashed words, after nnPU training."""

    def __init__(self):
        self.slot = np.zeros(1 << BITS, np.int32)  # bucket -> weight, 0: none
        self.weights = np.zeros((1, MODELS))
        self.bias = np.zeros(MODELS)

    def rows(self, indexes: list[np.ndarray]) -> sparse.Rows:
        """Known words of each text; the weight at 0 stays zero and keeps each row non-empty."""
        slots = [np.concatenate([[0], s[s > 0]]) for s in (self.slot[i] for i in indexes)]
        return sparse.Rows([(s, np.ones(len(s))) for s in slots])

    def fit(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> None:
        in_p, in_u = (np.bincount(np.concatenate(x), minlength=1 << BITS) for x in (positive, unlabelled))
        both = (in_p + in_u) / (len(positive) + len(unlabelled))
        error = np.sqrt(both * (1 - both) * (1 / len(positive) + 1 / len(unlabelled))) + 1e-12
        apart = np.abs(in_p / len(positive) - in_u / len(unlabelled)) / error
        kept = np.flatnonzero((in_p + in_u >= LEAST_ROWS) & (apart >= APART))
        self.slot[kept] = np.arange(1, len(kept) + 1)
        self.weights = np.zeros((len(kept) + 1, MODELS))
        p, u = self.rows(positive), self.rows(unlabelled)
        for m in range(MODELS):
            random = np.random.default_rng(m)
            w, b = np.zeros(len(kept) + 1), np.array([np.log(prior / (1 - prior))])
            step_w, step_b = sparse.Adam(w.shape, RATE), sparse.Adam((1,), RATE)
            batches = max(1, len(u) // BATCH)
            for _ in range(max(1, STEPS // batches)):
                for some_p, some_u in zip(np.array_split(random.permutation(len(p)), batches), np.array_split(random.permutation(len(u)), batches), strict=True):
                    if not len(some_p):
                        some_p = random.integers(0, len(p), 1)
                    xp, xu = p.take(some_p), u.take(some_u)
                    fp = np.add.reduceat(w[xp.index], xp.start) + b
                    fu = np.add.reduceat(w[xu.index], xu.start) + b
                    as_negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                    sp, su = sparse.sigmoid(fp), sparse.sigmoid(fu)
                    if as_negative >= 0:
                        gp = prior * ((sp - 1) - sp) / len(fp)  # loss as positive, less loss as negative
                        gu = su / len(fu)
                    else:  # undo the negative estimate
                        gp, gu = prior * sp / len(fp), -su / len(fu)
                    g = np.bincount(xp.index, gp[xp.row], len(w)) + np.bincount(xu.index, gu[xu.row], len(w)) + DECAY * w
                    g[0] = 0
                    step_w.step(w, g)
                    step_b.step(b, np.array([gp.sum() + gu.sum()]))
            self.weights[:, m], self.bias[m] = self._calibrated(w, b[0], p, u, prior)

    @staticmethod
    def _calibrated(w: np.ndarray, b: float, p: sparse.Rows, u: sparse.Rows, prior: float) -> tuple[np.ndarray, float]:
        """Scale and shift the raw scores so that they are odds.

        With logistic loss the class-prior-corrected risk is E_u[log(1 + e^f)] - prior * E_p[f]: convex in the two
        numbers, so a few Newton steps find them, again without a negative example.
        """
        fp = np.add.reduceat(w[p.index], p.start) + b
        fu = np.add.reduceat(w[u.index], u.start) + b
        xp, xu = np.stack([fp, np.ones_like(fp)], 1), np.stack([fu, np.ones_like(fu)], 1)
        a, ridge = np.array([1.0, 0.0]), np.diag([RIDGE, RIDGE / 100])
        for _ in range(30):
            s = sparse.sigmoid(xu @ a)
            gradient = (xu * s[:, None]).mean(0) - prior * xp.mean(0) + ridge @ (a - [1.0, 0.0])
            hessian = (xu * (s * (1 - s))[:, None]).T @ xu / len(xu) + ridge
            a = a - np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        return (w * a[0], b * a[0] + a[1]) if a[0] > 0 else (w, b)

    def score(self, indexes: list[np.ndarray]) -> np.ndarray:
        x = self.rows(indexes)
        raw = np.add.reduceat(self.weights[x.index], x.start) + self.bias
        return sparse.sigmoid(raw).mean(1)


def train(docs: DataFrame, labels: DataFrame, held_out: Column) -> Classifier:
    """Learn from labels outside the held-out fold: which texts are toxic, and which share of labelled ones is.

    Labels 0 serve the class prior alone. Both samples are bounded (POSITIVE_ROWS, UNLABELLED_ROWS) and fixed by
    hashed ids. Without a toxic example, all scores are the prior of one half.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    model = Classifier()
    if not prior:
        return model
    kind = docs.schema["doc_id"].dataType.simpleString()
    confirmed = common.stage(sparse.sample_ids(known.filter("toxic").select("doc_id"), POSITIVE_ROWS))
    # All text of the fold, whatever its label: confirmed examples belong to it at their share.
    unlabelled = common.stage(sparse.sample_ids(docs.filter(F.col("doc_id").isNotNull() & ~held_out).select("doc_id").distinct(), UNLABELLED_ROWS))
    ids = confirmed.withColumn("positive", F.lit(True)).union(unlabelled.withColumn("positive", F.lit(False)))
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # bounded by the two samples
    features = common.stage(chosen.mapInPandas(_features, f"doc_id {kind}, positive boolean, index array<int>"))
    positive = sparse.arrays(sparse.collect_rows(features.filter("positive"), POSITIVE_ROWS)["index"])
    rest = sparse.arrays(sparse.collect_rows(features.filter("not positive"), UNLABELLED_ROWS)["index"])
    if not positive:
        return model
    model.fit(positive, rest, float(np.clip(prior, 0.001, 0.99)))
    return model


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, score and verdict of each row; a null text is scored as an empty one."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[None, pd.DataFrame]]:
        buckets = sparse.Buckets(BITS)
        for batch in batches:
            indexes = [_buckets(t, buckets) for t in batch["text"]]
            p = np.concatenate([model.score(indexes[k : k + 256]) for k in range(0, len(indexes), 256)]) if indexes else np.empty(0)
            yield None, pd.DataFrame({"score": p, "predicted": (p >= threshold).astype("int32")})

    return common.map_beside(docs.select("doc_id", "text"), ["doc_id"], apply, "score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """Score all documents by classifiers that have seen no label of the held-out fold."""
    held_out = sparse.fold("doc_id", parts, held)
    return score(docs, train(docs, labels, held_out)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
