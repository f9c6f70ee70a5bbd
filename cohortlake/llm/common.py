"""Shared helpers: intermediate tables, words, hashes, row identity, ranks and components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
VOCAB_ROWS = 400_000  # entries of a worker's word cache before it is emptied; a cache only, results don't depend on it


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


Frames = Callable[[Iterator[pd.DataFrame]], Iterator[tuple[np.ndarray | None, pd.DataFrame]]]


def map_beside(df: DataFrame, carried: list[str], function: Frames, kinds: str) -> DataFrame:
    """Columns ``kinds`` that ``function`` makes of all columns but the ``carried`` ones, beside these.

    ``function`` takes pandas batches and yields, for each, a frame and the batch row of each of the frame's rows
    (None: one for one). Carried columns never become pandas ones, where integers beside a null turn into floats
    and lose digits: they stay Arrow columns.
    """
    made = StructType.fromDDL(kinds)
    whole = StructType([*[df.schema[c] for c in carried], *made])
    kept_types, made_types = to_arrow_schema(StructType(whole[: len(carried)])), to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []

        def frames() -> Iterator[pd.DataFrame]:
            for batch in batches:
                waiting.append(batch.select(carried))
                yield batch.select([n for n in batch.schema.names if n not in carried]).to_pandas()

        for rows, frame in function(frames()):
            kept, new = waiting.pop(), pa.RecordBatch.from_pandas(frame, schema=made_types, preserve_index=False)
            kept = kept if rows is None else kept.take(pa.array(rows, pa.int64()))
            columns = [c.cast(f.type) for c, f in zip(kept.columns, kept_types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *new.columns], names=whole.names)

    return df.mapInArrow(run, whole)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key(id_column: str = "doc_id", text: str = "text") -> Column:
    """Identity of a document: its id and its text. Rows that repeat both are one document and share a result."""
    return F.xxhash64(F.col(id_column), F.col(text).isNull(), text_or_empty(text))


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text, in order. bytes.split() splits at exactly \\x20 and \\x09-\\x0D."""
        if len(self) > VOCAB_ROWS:
            self.clear()
        words = (text or "").encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that each bit of a sum reaches all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


class Prefixes:
    """Prefix sums of a polynomial modulo 2**64: the hash of any run of a text's word hashes in one step."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        powers, back = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        powers[:1] = back[:1] = 1
        self.back = np.cumprod(back, dtype=np.uint64)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start])

    def windows(self, size: int) -> np.ndarray:
        """Hash of each run of ``size`` values."""
        n = len(self.back) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.total[size:] - self.total[:-size]) * self.back[:n])


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    return Prefixes(h).windows(size) if len(h) >= size else np.empty(0, np.uint64)


def shingle_set(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all ``size``-word shingles; a shorter text with words is one shingle of its own."""
    if 0 < len(h) < size:
        return window_hashes(h, len(h))
    return np.unique(window_hashes(h, size))


def shingle_column(words: Column, size: int) -> Column:
    """The ``size``-word shingles of a word array as strings, built natively; a short text is one shingle."""
    n = F.size(words)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(n - F.lit(size - 1), F.lit(1))),
            lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "),
        )
    )


def words_column(text: Column) -> Column:
    """Words of a text as an array, built natively."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(u, v)`` as (node, label), label the smallest node.

    Labels move along edges and then jump to the label of their label until nothing changes. All of it are
    aggregations with partial sums and joins that adaptive execution may split, so a hub of a third of all nodes
    is spread; each round is one written table, so the plan stays short.
    """
    spark = edges.sparkSession
    both = stage(
        edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    )
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        moved = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = stage(moved.join(jump, "next").select("node", "was", F.least("next", "far").alias("label")))
        changed = new.filter("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Join condition: equal in ``columns``, nulls equal to each other; the right side's are named with a trailing _."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"{c}_"]) for c in columns])


def numbered(df: DataFrame, group: list[str], order: list[Column], details: DataFrame | None = None) -> DataFrame:
    """``df`` with ``place``, each row's rank from 0 in its group by ``order``, and ``of``, the rows of its group.

    ``details`` has one row per group; its other columns are added too. A group may hold any share of the rows: all
    rows are sorted in ranges, a row's place in its range is read off its number there, and only one row per range
    and group is summed up and joined. Rows that tie go by their place in ``df``, which should be a written table.
    """
    tied = df.withColumn("table_at", F.monotonically_increasing_id())
    by = [*[F.col(c) for c in group], *order, F.col("table_at")]
    ranged = stage(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("table_at").withColumn("range_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("range_no", F.shiftright("range_at", 33))
    runs = ranged.groupBy("range_no", *group).agg(F.count(F.lit(1)).alias("n"), F.min("range_at").alias("run_first"))
    whole = W.partitionBy(*group)
    before = whole.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("run_start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("run_first")).withColumn("of", F.sum("n").over(whole))
    runs = runs.drop("n", "run_first").withColumnsRenamed({c: f"{c}_" for c in ["range_no", *group]})
    if details is not None:
        given = details.withColumnsRenamed({c: f"{c}_of" for c in group})
        match = reduce(lambda a, b: a & b, [runs[f"{c}_"].eqNullSafe(given[f"{c}_of"]) for c in group])
        runs = runs.join(given, match).drop(*[f"{c}_of" for c in group])
    out = ranged.join(runs, same(ranged, runs, ["range_no", *group]))
    return out.withColumn("place", F.col("range_at") + F.col("run_start")).drop("range_at", "range_no", "run_start", *[f"{c}_" for c in ["range_no", *group]])
