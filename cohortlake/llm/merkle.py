"""Merkle dataset manifest: trees of row digests, one per group, under one root.

Every level is a self-join: each node is sent to the other slots of its run, whose indices follow from its own by
slot offsets, and equijoined with the nodes that stand there. So each node holds its siblings, slot zero has the
whole run and emits the parent. Paths are then handed down level by level, from a parent to at most ``fan`` children.
All of it is DataFrame functions; no step gathers a group, however large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.llm import common

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGEST = 32  # bytes


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value: no two rows give one string."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """Digest (32 bytes) of a row."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def joined(digests: Column) -> Column:
    """Digest of concatenated digests, which enter as hexadecimal text."""
    return F.unhex(F.sha2(as_hex(digests), 256))


def siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """``nodes(tree, idx, n, digest, carry)`` with ``others``, the digests of the run's other nodes in order."""
    slot = F.col("idx") % fan
    to = F.col("idx") - slot + (slot + F.col("shift")) % fan
    sent = nodes.withColumn("shift", F.explode(F.sequence(F.lit(1), F.lit(fan - 1)))).filter(to < F.col("n"))
    sent = sent.select(F.col("tree").alias("to_tree"), to.alias("to_idx"), F.struct(slot.alias("slot"), F.col("digest").alias("other")).alias("sibling"))
    met = nodes.join(sent, (F.col("tree") == F.col("to_tree")) & (F.col("idx") == F.col("to_idx")), "left")
    run = met.groupBy("tree", "idx").agg(  # at most fan - 1 siblings
        *[F.any_value(c).alias(c) for c in ("n", "digest", "carry")], F.sort_array(F.collect_list("sibling")).alias("run")
    )
    others = F.aggregate("run", F.lit(b""), lambda a, x: F.concat(a, x["other"]))
    return run.select("tree", "idx", "n", "digest", "carry", others.alias("others"))


def grow(leaves: DataFrame, fan: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels of all trees: per level its nodes with siblings (trees of more than one node), and the finished trees."""
    levels, tops = [], []
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves
    while True:
        tops.append(nodes.filter("n = 1"))
        if most <= 1:
            return levels, tops
        levels.append(common.stage(siblings(nodes.filter("n > 1"), fan)))
        nodes = levels[-1].filter(F.col("idx") % fan == 0).select(
            "tree",
            F.floor(F.col("idx") / fan).cast("long").alias("idx"),
            F.ceil(F.col("n") / fan).cast("long").alias("n"),
            joined(F.concat("digest", "others")).alias("digest"),
            F.lit(None).cast(leaves.schema["carry"].dataType).alias("carry"),
        )
        most = -(-most // fan)


def hand_down(levels: list[DataFrame], tops: list[DataFrame], seeds: DataFrame, fan: int) -> DataFrame:
    """Per leaf: ``path``, its (slot, others) from the bottom up, before those of its tree's seed, and ``subroot``.

    ``seeds`` has (seed_tree, subroot, path).
    """
    paths = None
    for depth in reversed(range(len(tops))):
        ended = tops[depth].join(seeds, F.col("tree") == F.col("seed_tree")).drop("seed_tree")
        if paths is None:
            paths = ended
            continue
        above = paths.select(F.col("tree").alias("of_tree"), F.col("idx").alias("of_idx"), "subroot", "path")
        up = F.floor(F.col("idx") / fan).cast("long")
        below = levels[depth].join(above, (F.col("tree") == F.col("of_tree")) & (up == F.col("of_idx")))
        step = F.struct((F.col("idx") % fan).cast("int").alias("slot"), "others")
        columns = ["tree", "idx", "n", "digest", "carry", "subroot"]
        paths = below.select(*columns, F.concat(F.array(step), "path").alias("path")).unionByName(ended.select(*columns, "path"))
    return paths


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest gives with the siblings of its path."""

    def up(own: Column, step: Column) -> Column:
        cut = step["slot"] * DIGEST
        return joined(F.concat(F.substring(step["others"], F.lit(1), cut), own, F.substring(step["others"], cut + 1, F.lit(1 << 30))))

    return F.aggregate(path, digest, up)


def tampered(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Whether a row is tampered with (5 divides the CRC-32 of its decimal id), and the text that it then has."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return hit, F.translate(text, UPPER, LOWER)


def manifest(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row.

    Leaves of a source ascend by doc_id, a null id first; rows that share source and id go by their digest, and equal
    rows are leaves each. Null and empty values differ. A lone leaf is its source's subroot, a lone subroot the root,
    and the proof of a leaf without siblings is the digest of nothing. A null id is not tampered with. Texts of any
    length are hashed whole where they are read; an empty table gives no rows; other columns take no part.
    """
    spark = docs.sparkSession
    values = {c: F.col(c) for c in FIELDS}
    hit, changed = tampered(values["doc_id"], values["text"])
    other = leaf(list((values | {"text": changed}).values()))
    slim = common.stage(docs.select("doc_id", "source", leaf(list(values.values())).alias("digest"), F.when(hit, other).alias("tampered")))
    sources = common.stage(slim.select("source").distinct())
    trees = common.numbered(sources, [], [F.col("source")])
    trees = common.stage(trees.select("source", F.col("place").alias("tree"), F.col("of").alias("n_trees")))
    placed = common.numbered(slim, ["source"], [F.col("doc_id"), F.col("digest")], trees)
    leaves = common.stage(
        placed.select("tree", F.col("place").alias("idx"), F.col("of").alias("n"), "digest", F.struct("doc_id", "tampered").alias("carry"))
    )
    levels, tops = grow(leaves, fan)
    subroots = common.stage(_union([t.select("tree", "digest") for t in tops]))
    crown = subroots.join(trees, "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("n_trees").alias("n"), "digest", F.col("tree").alias("carry")
    )
    upper, ends = grow(crown, fan)
    top = _union(ends).first()
    root = bytes(top["digest"]) if top else b""
    no_path = F.array().cast("array<struct<slot:int,others:binary>>")
    seed = spark.range(1).select(F.lit(0).cast("long").alias("seed_tree"), F.lit(root).alias("subroot"), no_path.alias("path"))
    # A crown node's index is its tree's number, so its path is the seed of that tree.
    seeds = hand_down(upper, ends, seed, fan).select(F.col("idx").alias("seed_tree"), F.col("digest").alias("subroot"), "path")
    paths = hand_down(levels, tops, common.stage(seeds), fan)
    proof = F.array_join(F.transform("path", lambda p: as_hex(p["others"])), "")
    folded = fold(F.coalesce("carry.tampered", "digest"), F.col("path"))
    out = paths.select(F.col("carry.doc_id").alias("doc_id"), "digest", "subroot", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded"))
    return out.select(
        "doc_id",
        as_hex(F.col("digest")).alias("leaf"),
        as_hex(F.col("subroot")).alias("subroot"),
        as_hex(F.lit(root)).alias("root"),
        "proof_sha256",
        as_hex(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.lit(root)).alias("verified"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


#: CRC-32 of the decimal id is folded over a table of its polynomial, a path over its steps ``before|after``.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS crc
  FROM range(256) r(i)
),
w AS (
  SELECT *, xor(4294967295, list_reduce(
      list_concat([4294967295], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: unicode(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 5 = 0 AS hit
  FROM documents, t
),
x AS (
  SELECT doc_id, source, hit, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
         octet_length(encode(text)) || ':' AS size, text
  FROM w
),
d AS (
  SELECT doc_id, source, sha256(head || coalesce(size || text, '-')) AS leaf,
         CASE WHEN hit THEN sha256(head || coalesce(size || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
  FROM x
),
r AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n
  FROM d
),
lv AS (
  SELECT 0 AS l, g, i, n, leaf AS h FROM r
  UNION ALL SELECT l + 1, g, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY l, g, i // 16, n
),
sub AS (SELECT g, h AS subroot, count(*) OVER () AS n FROM lv WHERE n = 1),
up AS (
  SELECT 0 AS l, g AS i, n, subroot AS h FROM sub
  UNION ALL SELECT l + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY l, i // 16, n
),
s AS (
  SELECT 0 AS tree, l, g, i, coalesce(string_agg(h, '') OVER b, '') || '|' || coalesce(string_agg(h, '') OVER a, '') AS step
  FROM lv WHERE n > 1
  WINDOW b AS (PARTITION BY l, g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY l, g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
  UNION ALL
  SELECT 1, l, 0, i, coalesce(string_agg(h, '') OVER b, '') || '|' || coalesce(string_agg(h, '') OVER a, '')
  FROM up WHERE n > 1
  WINDOW b AS (PARTITION BY l, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY l, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
),
k AS (
  SELECT r.g, r.i, list(s.step ORDER BY s.tree, s.l) AS path
  FROM r JOIN s ON (s.tree = 0 AND s.g = r.g AND s.i = r.i // (16 ** s.l)::BIGINT) OR (s.tree = 1 AND s.i = r.g // (16 ** s.l)::BIGINT)
  GROUP BY r.g, r.i
),
o AS (
  SELECT r.*, sub.subroot, top.h AS root, coalesce(k.path, []) AS path
  FROM r JOIN sub ON r.g = sub.g JOIN (SELECT h FROM up WHERE n = 1) top ON true LEFT JOIN k ON r.g = k.g AND r.i = k.i
),
f AS (
  SELECT *, list_reduce(list_concat([coalesce(tampered, leaf)], path), lambda a, p: sha256(split_part(p, '|', 1) || a || split_part(p, '|', 2))) AS folded_root FROM o
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
