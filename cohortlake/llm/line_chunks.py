"""Line deduplication by content-defined chunks, in DataFrame functions alone.

A rolling hash over the hashes of two neighbouring lines chooses the boundaries: of any two neighbouring places
between lines the one with the smaller hash is a boundary, and so is each place whose two lines are long. That
depends on the lines beside a place alone, so a passage is cut alike wherever it stands. The chunks of a boundary are
its two lines, and these with a third one where the place beyond that line need not be a boundary. Chunks that occur
anywhere earlier, in order of document id and position, are removed; hashes nominate, texts are compared byte by byte.

A run of three or more lines that stands earlier is removed whole, and so is one of two lines with more than 50 words;
of shorter runs of two lines those are removed that are cut alike in both places. Lines without words don't count,
and go where they lie inside a run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortlake.llm import common

FACTOR, MODULUS = 1_000_003, 2_147_483_647  # of the rolling hash
LONG = 100  # characters of two lines that are always cut between; more than 50 words in two lines are 100 or more


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_hash(line: Column) -> Column:
    """The first 32 bits of the MD5 of a line."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _worded(lines: Column) -> Column:
    """(at, line): the lines that have words, with their places from 0."""
    placed = F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    return F.filter(placed, lambda x: x["line"].rlike(common.WORD))


def _chunks(worded: Column, long: int) -> Column:
    """Array of (no, size): chunks as the first of their worded lines, counted from 0, and how many there are."""

    def places(x: Column) -> Column:
        def place(j: Column) -> Column:
            a, b = F.get(x, j), F.get(x, j + 1)
            rolled = (a["h"] * FACTOR + b["h"]) % MODULUS
            return F.struct(rolled.alias("r"), (a["n"] + b["n"] >= long).alias("long"))

        return F.when(F.size(x) > 1, F.transform(F.sequence(F.lit(0), F.size(x) - 2), place)).otherwise(F.array().cast("array<struct<r:bigint,long:boolean>>"))

    def of(r: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            before, after = F.get(r, j - 1), F.get(r, j + 1)
            # A place beyond the text's ends is no boundary, so the first and last places always are.
            boundary = x["long"] | before.isNull() | after.isNull() | (x["r"] <= before["r"]) | (x["r"] <= after["r"])

            def wider(beside: Column, no: Column) -> Column:
                return F.when((beside["r"] > x["r"]) & ~beside["long"], F.struct(no.alias("no"), F.lit(3).alias("size")))

            found = F.array(F.struct(j.alias("no"), F.lit(2).alias("size")), wider(before, j - 1), wider(after, j))
            return F.when(boundary, F.filter(found, lambda c: c.isNotNull())).otherwise(F.array().cast("array<struct<no:int,size:int>>"))

        # Only the smaller one of two places widens over the other, so no chunk is named twice.
        return F.flatten(F.transform(r, one))

    hashed = F.transform(worded, lambda x: F.struct(line_hash(x["line"]).alias("h"), F.length(x["line"]).alias("n")))
    return let(let(hashed, places), of)


def _piece(worded: Column, c: Column) -> Column:
    return F.array_join(F.transform(F.slice(worded, c["no"] + 1, c["size"]), lambda x: x["line"]), "\n")


PLACE = ("doc_id", "key", "no")  # after null ids, which come last


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), *PLACE)


def _pieces(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, doc_id, no, start, end, h, piece): the texts of the chunks ``asked(key, no, size, start, end, h)``."""
    wanted = asked.groupBy("key").agg(F.collect_list(F.struct("no", "size", "start", "end", "h")).alias("wanted"))

    def cut(worded: Column) -> Column:
        return F.transform("wanted", lambda c: F.struct(c["no"], c["start"], c["end"], c["h"], _piece(worded, c).alias("piece")))

    texts = docs.dropDuplicates(["key"]).join(wanted, "key")
    return texts.select("key", "doc_id", F.explode(let(_worded(F.split("text", "\n")), cut)).alias("c")).select("key", "doc_id", "c.*")


def repeated_chunks(docs: DataFrame, long: int = LONG) -> DataFrame:
    """(key, start, end) of each chunk that stands earlier too; ``docs`` has key, doc_id and text.

    Only hashes of chunks are shuffled to find those that may repeat. The texts of those alone are then grouped,
    partially before they are shuffled, so a text that stands often is not sent as often. Where all texts of a hash
    are one, chunks are told by their hash; where they are not, by their text.
    """

    def described(worded: Column) -> Column:
        def one(c: Column) -> Column:
            last = F.get(worded, c["no"] + c["size"] - 1)["at"]
            return F.struct(c["no"], c["size"], F.get(worded, c["no"])["at"].alias("start"), (last + 1).alias("end"), F.xxhash64(_piece(worded, c)).alias("h"))

        return F.transform(_chunks(worded, long), one)

    found = docs.filter(F.col("text").isNotNull()).select("key", "doc_id", F.explode(let(_worded(F.split("text", "\n")), described)).alias("c"))
    # Chunks of one document count one by one, rows that repeat a document don't: they share its key.
    chunks = common.stage(found.select("key", "doc_id", "c.*").distinct())
    twice = chunks.groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("h")
    asked = common.stage(chunks.join(twice, "h", "left_semi"))
    texts = _pieces(docs, asked).groupBy("h", "piece").agg(F.min(_place()).alias("first"))
    firsts = common.stage(texts.groupBy("h").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("texts")))
    by_hash = asked.join(firsts.filter("texts = 1"), "h")
    mixed = common.stage(_pieces(docs, asked.join(firsts.filter("texts > 1").select("h"), "h", "left_semi")))
    by_text = mixed.join(mixed.groupBy("piece").agg(F.min(_place()).alias("first")), "piece")
    later = ~_place().eqNullSafe(F.col("first"))
    return by_hash.filter(later).select("key", "start", "end").union(by_text.filter(later).select("key", "start", "end"))


def _merged(ranges: DataFrame) -> DataFrame:
    """(key, gone): each document's ranges as sorted ones that don't touch; a group holds one document's ranges."""
    order = W.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = ranges.withColumn("fresh", F.when(reach >= F.col("start"), 0).otherwise(1))
    islands = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = islands.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))


def remove_repeated(docs: DataFrame, long: int = LONG, lines: str | None = None, removed: str | None = None) -> DataFrame:
    """``docs`` with the repeated chunks cut from ``text``; ``lines`` and ``removed`` name columns of line counts.

    The earliest place of a chunk keeps it: null ids come last, and two texts under one id go by their hash. Rows
    that repeat id and text get the same result and don't count as a repetition. Null texts stay null with zero
    lines. Other columns pass through.
    """
    key, ranges = common.unused(docs, "key"), common.unused(docs, "gone")
    keyed = docs.withColumn(key, common.row_key())
    gone = _merged(repeated_chunks(keyed.select(F.col(key).alias("key"), "doc_id", "text"), long))
    gone = gone.select(F.col("key").alias(key), F.col("gone").alias(ranges))

    def kept(all_lines: Column) -> Column:
        def between(k: Column) -> Column:
            before, after = F.get(ranges, k - 1), F.get(ranges, k)
            start = F.coalesce(before["end"], F.lit(0))
            return F.slice(all_lines, start + 1, F.coalesce(after["start"], F.size(all_lines)) - start)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ranges)), between))

    cut = F.when(F.col(ranges).isNull(), F.col("text")).otherwise(F.array_join(let(F.split("text", "\n"), kept), "\n"))
    out = keyed.join(gone, key, "left")
    columns = [cut.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    counts = {
        lines: F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"),
        removed: F.coalesce(F.aggregate(ranges, F.lit(0), lambda a, c: a + c["end"] - c["start"]), F.lit(0)).cast("long"),
    }
    return out.select(*columns, *[F.when(F.col("text").isNull(), F.lit(0)).otherwise(v).cast("long").alias(k) for k, v in counts.items() if k])


ORACLE = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d
),
h AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, length(line) AS n, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS j
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
r AS (
  SELECT *, (h * 1000003 + lead(h) OVER w) % 2147483647 AS r, n + lead(n) OVER w >= 100 AS long,
         lead(i, 1) OVER w AS i2, lead(i, 2) OVER w AS i3,
         line || chr(10) || lead(line, 1) OVER w AS two, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS three
  FROM h WINDOW w AS (PARTITION BY doc_id, text ORDER BY j)
),
b AS (
  SELECT *, lag(r) OVER w AS r_before, lead(r) OVER w AS r_after, lead(long) OVER w AS long_after
  FROM r WINDOW w AS (PARTITION BY doc_id, text ORDER BY j)
),
p AS (
  SELECT doc_id, text, j, i AS a, i2 AS z, two AS piece FROM b
  WHERE r IS NOT NULL AND (long OR r_before IS NULL OR r_after IS NULL OR r <= r_before OR r <= r_after)
  UNION ALL
  SELECT doc_id, text, j, i, i3, three FROM b
  WHERE (r_after > r AND NOT long_after) OR (r > r_after AND NOT long)
),
f AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY doc_id, j) AS times FROM p),
g AS (SELECT DISTINCT doc_id, text, unnest(generate_series(a, z)) AS i FROM f WHERE times > 1),
k AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.text = g.text AND l.i = g.i GROUP BY ALL
)
SELECT s.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, k.kept AS text
FROM documents s LEFT JOIN k ON s.doc_id = k.doc_id AND s.text = k.text
"""
