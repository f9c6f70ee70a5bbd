"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions alone.

Documents are partitioned by the size of their shingle set, in powers of two. A partition has one-permutation
MinHash bins in proportion to its size, so a short item inside a long document is as visible as in a short one: each
of its shingles is the minimum of its bin with a chance of about nine in ten. A document is a candidate for an item
if one of the item's shingles is a minimum of the document. Candidates are verified by the exact shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.llm import common
from cohortlake.llm.line_chunks import let

SHINGLE = 5
CONTAINED = 0.8
BIN_BITS = 3  # eight bins for each shingle that the largest set of a partition may have
SMALL = 8  # items with fewer shingles are looked up among all shingles of a document, not only the minima


def words(text: Column) -> Column:
    """Lower-case words without punctuation and symbols."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return common.words_column(plain)


def _hashes(text: Column) -> Column:
    """Sorted distinct hashes of a text's shingles."""

    def rolled(w: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
        return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), at)).otherwise(F.array().cast("array<long>"))

    return F.sort_array(F.array_distinct(let(words(text), rolled)))


def _minima(h: Column) -> Column:
    """The minima of the bins of a sorted set: an element with no smaller one in its bin."""

    def kept(bits: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (F.call_function("shiftrightunsigned", x, 64 - bits) != F.call_function("shiftrightunsigned", F.get(h, i - 1), 64 - bits)))

    bits = F.ceil(F.log2(F.greatest(F.size(h), F.lit(2)).cast("double"))).cast("int") + BIN_BITS
    return let(bits, kept)


def _shingles(text: Column) -> Column:
    """Distinct shingles as strings."""

    def joined(w: Column) -> Column:
        at = lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")
        return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), at)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(let(words(text), joined))


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (key, item_key) that share a minimum, or for small items any shingle. Both sides have key and text."""
    sets = items.select(F.col("key").alias("item_key"), _hashes(F.col("text")).alias("h"))
    looked = common.stage(sets.select("item_key", (F.size("h") < SMALL).alias("small"), F.explode("h").alias("x")))
    out = _found(docs, looked.filter("not small"), True)
    if looked.filter("small").limit(1).count():
        out = out.union(_found(docs, looked.filter("small"), False))
    return out.distinct()


def _found(docs: DataFrame, looked: DataFrame, minima: bool) -> DataFrame:
    h = _hashes(F.col("text"))
    probes = docs.select("key", F.explode(let(h, _minima) if minima else h).alias("x"))
    # Spark sends the items' shingles to all tasks while they are few, and shuffles both sides by shingle beyond that.
    return probes.join(looked.select("x", "item_key"), "x").select("key", "item_key").distinct()


def leaks(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) where a document holds ``contained`` of an item's shingles.

    Items and documents of fewer than five words have no shingles and take no part, nor do null texts. Rows that
    repeat a document or an item get a row each.
    """
    docs = docs.select("doc_id", "text", common.row_key().alias("key")).filter(F.col("text").isNotNull())
    items = items.select("item_id", "text", common.row_key("item_id").alias("key")).filter(F.col("text").isNotNull())
    pairs = common.stage(candidates(docs, items))
    wanted = pairs.join(items.select(F.col("key").alias("item_key"), "item_id", _shingles(F.col("text")).alias("item")), "item_key")
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("item_id", "item")).alias("wanted"))  # items are few per document: each shares text with it

    def compare(own: Column) -> Column:
        return F.transform("wanted", lambda w: F.struct(w["item_id"].alias("item_id"), F.size(F.array_intersect(own, w["item"])).cast("long").alias("n_shared"), F.size(w["item"]).cast("long").alias("n_item")))

    compared = docs.join(wanted, "key").select("doc_id", F.explode(let(_shingles(F.col("text")), compare)).alias("c")).select("doc_id", "c.*")
    share = F.col("n_shared") / F.col("n_item")
    return compared.filter(share >= contained).select("doc_id", "item_id", "n_shared", "n_item", share.alias("containment"))


def drop_leaks(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """The documents that hold no item. Null texts and ids stay."""
    key = common.unused(docs, "key")
    keyed = docs.withColumn(key, common.row_key())
    marked = keyed.select(F.col(key).alias("doc_id"), "text")
    found = leaks(marked, items, contained).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(found, key, "left_anti").select(docs.columns)


ORACLE = r"""
WITH norm AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 1, item_id, text FROM benchmark WHERE text IS NOT NULL
),
w AS (
  SELECT kind, id, text, [x FOR x IN regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM norm
),
s AS (
  SELECT DISTINCT kind, id, text, unnest([array_to_string(w[i:i+4], ' ') FOR i IN generate_series(1, len(w) - 4)]) AS g FROM w WHERE len(w) >= 5
),
n AS (SELECT id, text, count(*) AS n FROM s WHERE kind = 1 GROUP BY ALL),
p AS (
  SELECT d.id AS doc_id, d.text AS doc, b.id AS item_id, b.text AS item, count(*) AS k
  FROM s d JOIN s b ON d.g = b.g AND d.kind = 0 AND b.kind = 1 GROUP BY ALL
)
SELECT doc_id, item_id, k::BIGINT AS n_shared, n::BIGINT AS n_item, k::DOUBLE / n AS containment
FROM p JOIN n ON p.item_id = n.id AND p.item = n.text WHERE k::DOUBLE / n >= 0.8
"""
