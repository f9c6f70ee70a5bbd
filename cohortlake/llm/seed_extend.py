"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the ``anchor``-word grams inside each window of ``window`` words, the one with the
smallest hash (the last on a tie). Equal windows choose equal anchors at equal places, so two places that share a
window share the anchor in it, and it is enough to extend around anchors that occur twice. The windows that chose
one anchor occurrence are consecutive; their union is the anchor's span.

Places are joined on anchors without making pairs. An anchor is extended both ways to its span; equal spans fall
together at once, which settles the inside of every repeat. Only where spans around one anchor differ (at the edges
of repeats) are they compared window by window. Consecutive repeated windows are then merged to maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortlake.llm import common

WINDOW = 35
ANCHOR = 12


def _anchors(prefixes: common.Prefixes, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first window, last window) of each anchor occurrence of a text."""
    grams = prefixes.windows(anchor)
    width = window - anchor + 1
    n = len(prefixes.back) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    # Sliding minimum in logarithmic steps; ties go to the later place, so places are compared with ">=".
    best = np.arange(len(grams))
    size = 1
    while size < width:
        step = min(size, width - size)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(grams[a] >= grams[b], b, a)
        size += step
    chosen = best[:n]
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    return grams[chosen[first]], first, last


def _span_hashes(prefixes: common.Prefixes, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Hash of the words from the start of the first window to the end of the last one, and of their number."""
    return common.mix(prefixes.of(first, last + window) + (last - first).astype(np.uint64))


def seeds(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(anchor, span, key, first, last): each anchor occurrence of ``docs(key, text)`` with the windows that chose it."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = common.WordHash()
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                prefixes = common.Prefixes(words.of(text))
                a, first, last = _anchors(prefixes, window, anchor)
                if len(a):
                    s = _span_hashes(prefixes, first, last, window)
                    rows.append(pd.DataFrame({"anchor": a.view(np.int64), "span": s.view(np.int64), "key": np.full(len(a), key), "first": first.astype(np.int32), "last": last.astype(np.int32)}))
                if sum(map(len, rows)) > 50_000:
                    yield pd.concat(rows)
                    rows = []
            if rows:
                yield pd.concat(rows)

    return docs.mapInPandas(find, "anchor long, span long, key long, first int, last int")


def _extended(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(hash, span, key, start) of each window of the asked ``spans(key, first, last, span)``."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = common.WordHash()
        for batch in batches:
            for key, text, asked in zip(batch["key"], batch["text"], batch["asked"], strict=True):
                h = common.window_hashes(words.of(text), window)
                for k in range(0, len(asked), 2000):
                    part = asked[k : k + 2000]
                    starts = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in part])
                    span = np.repeat([r["span"] for r in part], [r["last"] - r["first"] + 1 for r in part])
                    yield pd.DataFrame({"hash": h[starts].view(np.int64), "span": span, "key": np.full(len(starts), key), "start": starts.astype(np.int32)})

    asked = spans.groupBy("key").agg(F.collect_list(F.struct("first", "last", "span")).alias("asked"))  # one text's own spans
    return docs.join(asked, "key").select("key", "text", "asked").mapInPandas(windows, "hash long, span long, key long, start int")


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(key, first, last): runs of window starts whose words also start elsewhere; ``docs`` has key and text.

    Rows that repeat a key are separate places. Runs may touch; ``maximal`` merges them.
    """
    found = common.stage(seeds(docs, window, anchor))
    # Most anchors stand once; only the others go on.
    twice = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.min("span").alias("low"), F.max("span").alias("high")).filter("times > 1")
    found = common.stage(found.join(twice.select("anchor", (F.col("low") != F.col("high")).alias("differ")), "anchor"))
    alike, found = found.filter("not differ").select("key", "first", "last"), found.filter("differ")
    # One row per distinct span, with its places counted; partial sums run before the shuffle.
    spans = common.stage(
        found.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("key", "first", "last")).alias("at"))
    )
    whole = alike.union(found.join(spans.filter("places > 1").select("anchor", "span"), ["anchor", "span"], "left_semi").select("key", "first", "last"))
    # Anchors around which spans differ: a window may still be shared by two of them.
    several = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("spans")).filter("spans > 1").select("anchor")
    edges = spans.join(several, "anchor", "left_semi").select("anchor", "span", "places", "at.*")
    extended = common.stage(_extended(docs.dropDuplicates(["key"]), edges, window))
    shared = extended.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("hash")
    # Spans with several places are settled above; one place stood for them here.
    single = extended.join(edges.filter("places = 1").select("key", "span", "first", "last"), ["key", "span"]).filter("start between first and last")
    part = single.join(shared, "hash", "left_semi").select("key", F.col("start").alias("first"), F.col("start").alias("last"))
    return whole.union(part)


def _cover(runs: list, window: int) -> list[tuple[int, int]]:
    """Word ranges [a, b) of the maximal repeats that runs of window starts make."""
    out: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + window)
        else:
            out.append([first, last + window])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept (words joined by a space) and the repeats' word ranges.

    A word goes if any window over it also starts elsewhere, in another row or in the same text; all copies go.
    Rows that repeat id and text are copies of each other like any others. A null text has no words.
    """
    keyed = docs.select("doc_id", common.text_or_empty().alias("text"), common.row_key().alias("key"))
    runs = repeats(keyed.select("key", "text"), window, anchor).distinct()
    runs = common.stage(runs.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[None, pd.DataFrame]]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch["text"], batch["runs"], strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                ranges = _cover(runs, window) if runs is not None else []
                keep, at = [], 0
                for a, b in ranges:
                    keep += words[at:a]
                    at = b
                keep += words[at:]
                kept = b" ".join(keep)
                rows.append((len(words), len(words) - len(keep), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass"), [{"a": a, "b": b} for a, b in ranges]))
            yield None, pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept", "ranges"])

    kinds = "n_words long, n_removed long, kept_sha256 string, kept string, ranges array<struct<a: int, b: int>>"
    return common.map_beside(keyed.join(runs, "key", "left").select("doc_id", "text", "runs"), ["doc_id"], cut, kinds)
