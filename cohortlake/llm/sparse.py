"""Hashed word features as compressed sparse rows, and small helpers for numpy classifiers on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.llm import common

EDGE = " .,;:!?\"'()[]{}*#$%&|<>-_"


class Buckets(dict):
    """word (bytes) -> bucket of its lower-case form without punctuation at the edges, remembered."""

    def __init__(self, bits: int, seed: int = 0):
        super().__init__()
        self.mask, self.seed = (1 << bits) - 1, seed

    def __missing__(self, word: bytes) -> int:
        core = word.decode("utf-8", "surrogatepass").lower().strip(EDGE)
        b = self[word] = xxhash.xxh3_64_intdigest(core.encode("utf-8", "surrogatepass"), self.seed) & self.mask
        return b

    def of(self, text: str) -> np.ndarray:
        if len(self) > common.VOCAB_ROWS:
            self.clear()
        words = text.encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Rows:
    """Sparse rows: ``index`` and ``value`` of all entries, ``start`` of each row. No row is empty."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        size = np.array([len(i) for i, _ in rows], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        self.index = np.concatenate([i for i, _ in rows]).astype(np.int64)
        self.value = np.concatenate([v for _, v in rows]).astype(np.float64)
        self.row = np.repeat(np.arange(len(rows)), size)
        self.size = size

    def __len__(self) -> int:
        return len(self.size)

    def take(self, some: np.ndarray) -> Rows:
        out = Rows.__new__(Rows)
        out.size = self.size[some]
        out.start = np.concatenate([[0], np.cumsum(out.size)[:-1]]).astype(np.int64)
        at = np.repeat(self.start[some] - out.start, out.size) + np.arange(out.size.sum())
        out.index, out.value = self.index[at], self.value[at]
        out.row = np.repeat(np.arange(len(some)), out.size)
        return out


class Adam:
    def __init__(self, shape: tuple[int, ...], rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, x: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fold(key: str, parts: int, held: int) -> Column:
    """Whether crc32 of the id as text leaves ``held`` modulo ``parts``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)) == held, F.lit(False))


def sample_ids(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """``most`` rows at most, those whose hashed id is smallest: a fixed sample of any table."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def collect_rows(rows: DataFrame, most: int) -> pa.Table:
    """A bounded sample to the driver, for fitting."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toArrow()


def arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column, as views of its flat values."""
    out = []
    for chunk in column.chunks:
        values, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(at, at[1:], strict=False)]
    return out
