"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is w0 + sum w_i x_i + sum_(i<j) <v_i, v_j> x_i x_j. The pairwise part is computed in time linear
in the entries, as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortlake.llm import common, sparse

BITS = 15  # word buckets
STRUCTURE = ("bias", "length", "mean_word", "upper", "symbol", "digit", "punct", "dup_lines", "repeat", "distinct", "line_words", "ascii", "chars_listed")
FACTORS = 8
TRAIN_ROWS = 12_000  # most labelled documents that the model is fitted on
EPOCHS = 12
LEAST_STEPS = 400  # a small sample gets more epochs
BATCH = 256
RATE = 0.02
DECAY = 1e-4
WORD_WEIGHT = 0.5  # norm of a text's word entries, beside structure entries of about one each
THRESHOLD = 0.3


def _entries(text: str, n_chars: float, buckets: sparse.Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Structure statistics first, then the distinct word buckets."""
    word = buckets.of(text)
    n = len(word)
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    white = int(byte[[9, 10, 11, 12, 13, 32]].sum())
    size = int(byte.sum())
    chars = max(size - white, 1)
    lines = [x for x in text.split("\n") if x.strip(common.SPACES)]
    index, count = np.unique(word, return_counts=True)
    three = np.sort(common.window_hashes(word.astype(np.uint64), 3))
    again = int((three[1:] == three[:-1]).sum())
    symbols = int(byte[[ord(c) for c in "#*$%&|<>@^~_=+/\\"]].sum())
    structure = np.array([
        1.0,
        np.log1p(n) / 5,
        chars / max(n, 1) / 6,
        byte[65:91].sum() / chars * 4,
        np.sqrt(symbols / chars) * 3,
        np.sqrt(byte[48:58].sum() / chars) * 3,
        byte[[33, 44, 46, 58, 59, 63]].sum() / max(n, 1) * 2,
        np.sqrt((len(lines) - len(set(lines))) / max(len(lines), 1)) * 3,
        np.sqrt(again / max(n, 1)) * 3,
        len(index) / max(n, 1),
        np.log1p(n / max(len(lines), 1)) / 3,
        byte[:128].sum() / max(size, 1),
        np.log1p(n_chars if n_chars == n_chars else len(text)) / 8,
    ])
    value = np.sqrt(count)
    value = WORD_WEIGHT * value / max(np.sqrt((value**2).sum()), 1e-9)
    return np.concatenate([np.arange(len(STRUCTURE)), index + len(STRUCTURE)]), np.concatenate([structure, value])


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    buckets = sparse.Buckets(BITS)
    for batch in batches:
        rows = [_entries(t if isinstance(t, str) else "", c, buckets) for t, c in zip(batch["text"], batch["n_chars"].astype(float), strict=True)]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "index": [i.astype(np.int32) for i, _ in rows], "value": [v.astype(np.float32) for _, v in rows]})


class Machine:
    """Parameters and the linear-time score."""

    def __init__(self, size: int, factors: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.w = np.zeros(size)
        self.v = random.normal(0, 0.05, (size, factors))

    def parts(self, x: sparse.Rows) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores, and sum_i v_if x_i of each row."""
        scaled = self.v[x.index] * x.value[:, None]
        sums = np.add.reduceat(scaled, x.start)
        squares = np.add.reduceat((scaled * scaled).sum(1), x.start)
        linear = np.add.reduceat(self.w[x.index] * x.value, x.start)
        return linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, x: sparse.Rows) -> np.ndarray:
        return sparse.sigmoid(self.parts(x)[0])

    def fit(self, x: sparse.Rows, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> None:
        """Logistic loss by mini-batches; the rarer class gets the weight of the square root of the odds."""
        random = np.random.default_rng(seed)
        share = float(np.clip(y.mean(), 0.01, 0.99))
        weight = np.where(y > 0, 1.0, np.sqrt(share / (1 - share)))
        step_w, step_v = sparse.Adam(self.w.shape, RATE), sparse.Adam(self.v.shape, RATE / 2)
        for _ in range(max(epochs, LEAST_STEPS * BATCH // len(y))):
            order = random.permutation(len(y))
            for k in range(0, len(y), BATCH):
                some = order[k : k + BATCH]
                part = x.take(some)
                raw, sums = self.parts(part)
                g = (sparse.sigmoid(raw) - y[some]) * weight[some] / len(some)
                each = g[part.row] * part.value
                gw = np.bincount(part.index, each, len(self.w)) + DECAY * self.w
                inner = each[:, None] * (sums[part.row] - self.v[part.index] * part.value[:, None])
                gv = np.stack([np.bincount(part.index, inner[:, f], len(self.w)) for f in range(self.v.shape[1])], 1) + DECAY * self.v
                step_w.step(self.w, gw)
                step_v.step(self.v, gv)


def train(docs: DataFrame, labels: DataFrame, held_out, most: int = TRAIN_ROWS) -> Machine:
    """Fit on at most ``most`` labelled documents for which ``held_out`` is false.

    Repeated labels of a document are averaged. Without any labelled row, scores stay at one half.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    ids = common.stage(sparse.sample_ids(known, most))
    chosen = docs.select("doc_id", "text", "n_chars").join(F.broadcast(ids), "doc_id")  # ids: TRAIN_ROWS rows at most
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label double, index array<int>, value array<float>"
    table = sparse.collect_rows(chosen.mapInPandas(_features, kinds), most)
    machine = Machine(len(STRUCTURE) + (1 << BITS), FACTORS)
    if len(table):
        rows = list(zip(sparse.arrays(table["index"]), sparse.arrays(table["value"]), strict=True))
        machine.fit(sparse.Rows(rows), table["label"].to_numpy())
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, score and verdict of each row; a null text is scored as an empty one."""
    model = machine

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[None, pd.DataFrame]]:
        buckets = sparse.Buckets(BITS)
        for batch in batches:
            rows = [_entries(t if isinstance(t, str) else "", c, buckets) for t, c in zip(batch["text"], batch["n_chars"].astype(float), strict=True)]
            p = np.concatenate([model.score(sparse.Rows(rows[k : k + 64])) for k in range(0, len(rows), 64)]) if rows else np.empty(0)
            yield None, pd.DataFrame({"score": p, "predicted": (p >= threshold).astype("int32")})

    return common.map_beside(docs.select("doc_id", "text", "n_chars"), ["doc_id"], apply, "score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """Score all documents by a model that has seen no label of the held-out fold."""
    held_out = sparse.fold("doc_id", parts, held)
    machine = train(docs, labels, held_out)
    return score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")
