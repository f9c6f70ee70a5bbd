"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

The statistic vectors of a group are compared with a minimum-covariance-determinant estimate of that group. The
estimate covers all rows: each concentration step is one distributed aggregation, in which every row adds its
moments to a cell (group, distance band). A group then keeps the nearest cells that hold the asked share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.llm import common

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("f_length", "f_symbol", "f_line", "f_repeat", "f_upper", "f_punct")
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
FLOOR = (0.30, 0.02, 0.05, 0.05, 0.02, 0.02)  # least spread of each transformed statistic: below it lies no judgement
SHARE = 0.75  # of a group's rows that the estimate rests on
BANDS_PER_UNIT = 16  # distance bands per unit of log2(1 + distance)
STEPS = 6
BORROWED = 200.0  # rows that the next wider estimate is worth: a group of n rows has weight n / (n + BORROWED) in its own
CHI2_SHARE = 7.84  # chi-square quantile of SHARE with P = 6 degrees of freedom
CHI2_INSIDE = 0.652  # chance that a chi-square value with P + 2 degrees is below CHI2_SHARE; scales covariances back
CUTOFF = 200.0  # squared Mahalanobis distance beyond which a document goes


WHITE, SYMBOL, PUNCT = (np.frombuffer(x.encode(), np.uint8) for x in (common.SPACES, SYMBOLS, ".,;:!?"))


def _repeat_words(ids: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more in the text."""
    if len(ids) < 4:
        return 0
    h = common.window_hashes(ids, 3)
    order = np.sort(h)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    hit = np.isin(h, again)
    cover = np.zeros(len(ids), bool)
    for k in range(3):
        cover[k : k + len(hit)] |= hit
    return int(cover.sum())


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[None, pd.DataFrame]]:
    words = common.WordHash()
    for batch in batches:
        rows = []
        for text in batch["text"]:
            text = text if isinstance(text, str) else ""
            ids = words.of(text)
            n = len(ids)
            byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
            chars = int(byte.sum() - byte[0x80:0xC0].sum() - byte[WHITE].sum())  # code points but for white space
            symbols = int(byte[SYMBOL].sum())
            lines = [x for x in text.split("\n") if x.strip(common.SPACES)]
            dup = len(lines) - len(set(lines))
            repeat = _repeat_words(ids)
            upper = byte[65:91].sum() / max(chars, 1)
            punct = byte[PUNCT].sum() / max(n, 1)
            rows.append((n, chars, symbols, dup, repeat, np.log1p(n), np.sqrt(symbols / max(chars, 1)), np.sqrt(dup / max(len(lines), 1)), np.sqrt(repeat / max(n, 1)), np.sqrt(upper), np.sqrt(punct)))
        yield None, pd.DataFrame(rows, columns=[*BASE, *FEATURES])


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The counted statistics and their transforms, one row per document, with the columns ``keep``."""
    kinds = ", ".join([f"{c} long" for c in BASE] + [f"{c} double" for c in FEATURES])
    return common.map_beside(docs.select(*keep, "text"), keep, _statistics, kinds)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _cells(rows: DataFrame) -> DataFrame:
    """Count and moments of each (group, band), then of the wider groups."""
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    squares = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i, j in PAIRS]
    return _levels(rows.groupBy("g", "up", "band").agg(F.count(F.lit(1)).alias("n"), *sums, *squares), ["band"])


def _levels(cells: DataFrame, by: list[str]) -> DataFrame:
    """``cells`` of each group ``g``, then of each language ``up`` and of all rows, ``*``, as further groups."""
    summed = [F.sum(c).alias(c) for c in cells.columns if c not in ("g", "up", *by)]
    languages = cells.groupBy(F.col("up").alias("g"), *by).agg(*summed).withColumn("up", F.lit("*"))
    whole = languages.groupBy(*by).agg(*summed).withColumns({"g": F.lit("*"), "up": F.lit(None).cast("string")})
    return cells.unionByName(languages).unionByName(whole)


def _fit(cells: pd.DataFrame) -> pd.DataFrame:
    """Mean and covariance from a group's nearest bands that hold the asked share of its rows."""
    cells = cells.sort_values("band")
    n = cells["n"].to_numpy(float)
    take = np.searchsorted(np.cumsum(n), SHARE * n.sum() - 1e-9) + 1
    some = cells.iloc[:take]
    m = n[:take].sum()
    mean = np.array([some[f"s{i}"].sum() for i in range(P)]) / m
    cov = np.empty((P, P))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = some[f"q{i}_{j}"].sum() / m - mean[i] * mean[j]
    share = m / n.sum()
    if len(cells) > 1 and share < 0.999:
        cov *= SHARE / CHI2_INSIDE
    return _as_fit(cells, n.sum(), mean, cov)


FIT = "g string, up string, size long, mean array<double>, cov array<double>"


def _as_fit(group: pd.DataFrame, size: float, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"g": [group["g"].iloc[0]], "up": [group["up"].iloc[0]], "size": [int(size)], "mean": [mean.tolist()], "cov": [[float(cov[i, j]) for i, j in PAIRS]]})


def shrunk(size: float, own: np.ndarray, wider: np.ndarray) -> np.ndarray:
    """A group's estimate, drawn to the wider one by a weight that falls smoothly as its rows grow in number."""
    weight = size / (size + BORROWED)
    return weight * own + (1 - weight) * wider


def _shrunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for x in batch.itertuples(index=False):
            mean, cov = (
                shrunk(x.size, np.asarray(own), shrunk(x.size_up, np.asarray(up), np.asarray(whole)))
                for own, up, whole in ((x.mean, x.mean_up, x.mean_all), (x.cov, x.cov_up, x.cov_all))
            )
            full = np.diag(np.square(FLOOR))
            for k, (i, j) in enumerate(PAIRS):
                full[i, j] += cov[k]
                full[j, i] = full[i, j]
            inverse = np.linalg.inv(full)
            out.append((x.g, mean.tolist(), [float(inverse[i, j]) for i, j in PAIRS]))
        yield pd.DataFrame(out, columns=["g", "mean", "inv"])


def _distance() -> Column:
    d = [F.col(f) - F.col("mean")[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total = total + (1.0 if i == j else 2.0) * F.col("inv")[k] * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


def _with_fit(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Rows with ``mean`` and ``inv``: the estimate of their group, drawn to their language's, and that to all rows'."""
    named = ["g", "size", "mean", "cov"]
    whole = fits.filter("g = '*'").select(F.lit("*").alias("top"), F.col("mean").alias("mean_all"), F.col("cov").alias("cov_all"))  # one row
    languages = fits.filter("up = '*'").select(F.col("up").alias("top"), *[F.col(c).alias(f"{c}_up") for c in named])
    own = fits.join(languages, fits["up"] == languages["g_up"]).join(whole, "top")
    own = own.select(*named, "size_up", "mean_up", "cov_up", "mean_all", "cov_all").mapInPandas(_shrunk, "g string, mean array<double>, inv array<double>")
    return rows.drop("mean", "inv").join(own, "g", "left")


def _start(rows: DataFrame) -> DataFrame:
    """First estimates: each group's coordinatewise median and spread, from exact counts of finely rounded values."""
    steps = 512.0  # a rounded value is within 1/1024 of the statistic
    long = rows.select("g", "up", F.posexplode(F.array(*[F.round(F.col(f) * steps).cast("long") for f in FEATURES])).alias("f", "v"))
    counted = _levels(long.groupBy("g", "up", "f", "v").agg(F.count(F.lit(1)).alias("n")), ["f", "v"])

    def quantiles(counts: pd.DataFrame) -> pd.DataFrame:
        mean, var, size = np.zeros(P), np.zeros(P), 0
        for f, part in counts.groupby("f"):
            part = part.sort_values("v")
            total = part["n"].cumsum().to_numpy()
            v, size = part["v"].to_numpy() / steps, total[-1]
            lo, mid, hi = (v[np.searchsorted(total, q * size - 1e-9)] for q in (0.25, 0.5, 0.75))
            mean[f], var[f] = mid, ((hi - lo) / 1.349) ** 2
        return _as_fit(counts, size, mean, np.diag(var))

    # A group's rounded values are bounded by the range of the statistics, not by its rows.
    return counted.groupBy("g").applyInPandas(quantiles, FIT)


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """MCD estimate per group ``g``, per language and (``*``) for all rows after ``steps`` concentration steps."""
    fits = common.stage(_start(rows))
    for _ in range(steps):
        banded = _with_fit(rows, fits).withColumn("band", F.floor(F.log2(1 + _distance()) * BANDS_PER_UNIT).cast("int"))
        fits = common.stage(_cells(banded).groupBy("g").applyInPandas(_fit, FIT))
    return fits


def judge(docs: DataFrame, keep: list[str] | None = None, cutoff: float = CUTOFF) -> DataFrame:
    """Statistics, ``base_failed``, ``distance`` (squared, robust) and ``kept`` for every row of ``docs``.

    Null or empty texts have zero words and fail the base rules. Null languages and sources form groups of their
    own. Repeated rows are judged one by one and count one by one. A group's estimate is drawn to that of its language,
    and this to that of all rows, the less the more rows it has; no number of rows switches. The estimates rest on the rows that pass the
    base rules; with none there is nothing to judge and nothing is kept.
    """
    keep = keep or ["doc_id"]
    names = list(dict.fromkeys([*keep, "lang", "source"]))
    groups = {"g": F.concat(F.lit("group "), F.to_json(F.struct("lang", "source"))), "up": F.concat(F.lit("language "), F.to_json(F.struct("lang")))}
    rows = common.stage(statistics(docs, names).withColumns(groups).withColumn("base_failed", base_failed()))
    passed = rows.filter("not base_failed")
    fits = estimates(passed.select("g", "up", *FEATURES))
    scored = _with_fit(rows, fits).withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.col("distance") <= cutoff, F.lit(False)))
    return scored.withColumn("kept", kept).select(*keep, *BASE, "base_failed", "kept", "distance")


def filter_documents(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    key = common.unused(docs, "key")
    keyed = docs.withColumn(key, common.row_key())
    verdict = judge(keyed.select(key, "text", "lang", "source"), [key], cutoff).filter("kept").select(key).distinct()
    return keyed.join(verdict, key, "left_semi").select(docs.columns)
