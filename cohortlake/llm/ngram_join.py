"""Jaccard self-join on word n-grams by banded MinHash, with exact verification.

Fixed bands replace the LSH forest: the depth of the label prefixes follows from threshold and target recall alone,
before any data is read, and no longer labels, sorted tries or adaptive shortening exist. A pair at the threshold meets
in some of the bands, called trees here, with the target recall.

Nodes are groups of a shuffle by prefix. Their members are linked to the node's first member, not to each other, and
the connected components of these links hold all candidate pairs. Components are verified exactly by block against
block: a task counts the links of its texts by intersecting shingle sets, so that no pair of texts is ever a row.
Texts with equal shingle sets are one class from the start, and only its representative takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from cohortlake.llm import common

SHINGLE = 5
THRESHOLD = 0.8
TREES = 64
DEPTH = 12  # values of a full label
RECALL = 0.9999  # for a pair just at the threshold; higher for closer pairs
UNIT = 150_000  # shingles of a block


def prefix_depth(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Longest prefix at which a pair at the threshold meets in some tree with the target recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _signatures(shingles: np.ndarray, trees: int, depth: int, factors: np.ndarray, combine: np.ndarray) -> np.ndarray:
    """The label prefix of each tree, as a hash of its MinHash values and the tree."""
    low = np.empty(trees * depth, np.uint64)
    step = max(1, 250_000 // len(shingles))
    for k in range(0, len(low), step):
        low[k : k + step] = (shingles[None, :] * factors[k : k + step, None]).min(1)
    values = common.mix(low).reshape(trees, depth)
    return common.mix((values * combine[None, :]).sum(1) + np.arange(1, trees + 1, dtype=np.uint64))


def described(docs: DataFrame, trees: int, depth: int, shingle: int) -> DataFrame:
    """(key, doc_id, signature of the shingle set, its size, tree labels) of each row of ``docs(key, doc_id, text)``."""
    random = np.random.default_rng(11)
    factors = random.integers(0, 1 << 63, trees * depth, np.uint64) * np.uint64(2) + np.uint64(1)
    combine = random.integers(0, 1 << 63, depth, np.uint64) * np.uint64(2) + np.uint64(1)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[None, pd.DataFrame]]:
        words = common.WordHash()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = common.shingle_set(words.of(text), shingle)
                labels = _signatures(s, trees, depth, factors, combine).view(np.int64) if len(s) else np.empty(0, np.int64)
                rows.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), labels))
            yield None, pd.DataFrame({"sig": [r[0] for r in rows], "n": [r[1] for r in rows], "labels": [r[2] for r in rows]})

    return common.map_beside(docs, ["key", "doc_id"], describe, "sig binary, n long, labels array<long>")


def _candidates(classes: DataFrame) -> DataFrame:
    """(node, label): components of classes that share a trie node; classes without company are left out."""
    members = common.stage(classes.select("cid", F.explode("labels").alias("label")))
    nodes = members.groupBy("label").agg(F.min("cid").alias("u"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("label", "u")
    links = members.join(nodes, "label").select("u", F.col("cid").alias("v")).filter("u <> v")
    # A text's nodes may have several first members, one per tree at most. It is linked to the smallest of them, and
    # the others are too, once for all texts they share: as connected, with hardly more links than texts.
    firsts = common.stage(links.groupBy("v").agg(F.sort_array(F.collect_set("u")).alias("us")))
    star = firsts.select(F.get("us", F.lit(0)).alias("u"), "v")
    others = firsts.select(F.get("us", F.lit(0)).alias("u"), F.explode(F.slice("us", F.lit(2), F.size("us"))).alias("v")).distinct()
    return common.components(star.union(others))


def _tasks(members: DataFrame, threshold: float, unit: int) -> DataFrame:
    """``members(cid, comp, n)`` dealt to tasks (task, side): small components share tasks, large ones are cut.

    A large component is cut by size, so that linked texts are in the same class or in neighbouring ones, and each
    class by hash into blocks of about ``unit`` shingles. A task compares one block with itself or another (side 1).
    """
    level = F.floor(F.log("n") / float(-np.log(threshold)) + 1e-9).cast("int")
    sizes = members.groupBy("comp").agg(F.sum("n").alias("total"))
    total_small = sizes.filter(F.col("total") <= unit).agg(F.sum("total")).first()[0] or 0
    groups = int(total_small // unit) + 1
    known = members.join(sizes, "comp")
    small = known.filter(F.col("total") <= unit).select("cid", F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("comp"), F.lit(groups))).alias("task"), F.lit(0).alias("side"))
    large = known.filter(F.col("total") > unit).withColumn("level", level)
    blocks = large.groupBy("comp", "level").agg(F.ceil(F.sum("n") / unit).cast("int").alias("blocks"))
    near = lambda d, name: blocks.select("comp", (F.col("level") + d).alias("level"), F.col("blocks").alias(name))
    placed = large.join(near(0, "own"), ["comp", "level"]).join(near(-1, "above"), ["comp", "level"], "left").join(near(1, "below"), ["comp", "level"], "left")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("own")).cast("int"))

    def each(count: str, lower, upper, left, right, side) -> F.Column:
        numbers = F.when(F.coalesce(F.col(count), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda j: F.struct(F.xxhash64("comp", lower, upper, left(j), right(j)).alias("task"), side(j).alias("side")))

    b, c = F.col("block"), F.col("level")
    own = each("own", c, c, lambda j: F.least(b, j), lambda j: F.greatest(b, j), lambda j: F.when(b > j, F.lit(1)).otherwise(F.lit(0)))
    above = each("above", c, c + 1, lambda j: b, lambda j: j, lambda j: F.lit(0))
    below = each("below", c - 1, c, lambda j: j, lambda j: b, lambda j: F.lit(1))
    cut = placed.select("cid", F.explode(F.concat(own, above, below)).alias("t")).select("cid", "t.*")
    return small.union(cut)


def _linked(sets: list[np.ndarray], probe: np.ndarray, against: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those of ``against`` whose set is at least ``threshold`` like that of i) for each i of ``probe``."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(against, size[against])
    token = np.concatenate([sets[i] for i in against])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for i in probe:
        a, b = np.searchsorted(token, sets[i]), np.searchsorted(token, sets[i], side="right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        hit = np.flatnonzero(shared >= threshold * (size[i] + size - shared) - 1e-9)
        yield i, hit[(hit != i) & (shared[hit] > 0)]


def verified(docs: DataFrame, tasks: DataFrame, weights: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(cid, root, texts, rows) per task: links found there, and the text that stands for those linked in this task."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = common.WordHash()
        for batch in batches:
            yield pd.DataFrame({"cid": batch["key"], "shingles": [common.shingle_set(words.of(t), shingle).view(np.int64) for t in batch["text"]]})

    def count(group: pd.DataFrame) -> pd.DataFrame:
        values = [np.asarray(s, np.int64) for s in group["shingles"]]
        side, weight, cid = group["side"].to_numpy(), group["weight"].to_numpy(), group["cid"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        texts, rows, parent = np.zeros(len(cid), np.int64), np.zeros(len(cid), np.int64), list(range(len(cid)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        if len(left):
            for i, hit in _linked(values, right if len(right) else left, left, threshold):
                texts[i] += len(hit)
                rows[i] += weight[hit].sum()
                if len(right):  # counted once from this side, so the other side gets its part here too
                    texts[hit] += 1
                    rows[hit] += weight[i]
                for j in hit:
                    a, b = root(int(i)), root(int(j))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
        return pd.DataFrame({"cid": cid, "root": cid[[root(i) for i in range(len(cid))]], "texts": texts, "rows": rows})

    wanted = weights.join(tasks.select("cid").distinct(), "cid", "left_semi")
    texts = docs.dropDuplicates(["key"]).join(wanted.withColumnRenamed("cid", "key"), "key").select("key", "text").mapInPandas(sets, "cid long, shingles array<long>")
    dealt = tasks.join(weights, "cid").join(texts, "cid")
    return dealt.groupBy("task").applyInPandas(count, "cid long, root long, texts long, rows long")


def join(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES, recall: float = RECALL, unit: int = UNIT) -> DataFrame:
    """Per row: doc_id, copy_id, class_id, n_text_links and n_links.

    ``copy_id`` is the smallest doc_id with the same shingle set, ``class_id`` the smallest one of all texts that are
    connected by links. ``n_text_links`` counts the other shingle sets at least ``threshold`` like the own one,
    ``n_links`` the other rows at least as like, copies included. Texts of fewer words than a shingle have their
    words as one shingle; null, empty and blank texts have the same, empty, set. Null ids come last. ``key`` is the
    row's identity and ``label`` that of its class, also where ids are null.
    """
    keyed = docs.select("doc_id", common.text_or_empty().alias("text"), common.row_key().alias("key"))
    rows = common.stage(described(keyed, trees, prefix_depth(trees, DEPTH, threshold, recall), shingle))
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("copy_id"), F.col("key").alias("cid"))
    classes = common.stage(rows.groupBy("sig").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n")).select("sig", "first.cid", "first.copy_id", "weight", "n"))
    labelled = rows.select(F.col("key").alias("cid"), "sig", "labels").join(classes.select("sig", "cid"), ["sig", "cid"]).dropDuplicates(["cid"])
    members = _candidates(labelled.select("cid", "labels")).select(F.col("node").alias("cid"), F.col("label").alias("comp"))
    members = common.stage(members.join(classes.select("cid", "n"), "cid"))
    tasks = common.stage(_tasks(members, threshold, unit))
    found = common.stage(verified(keyed.select("key", "text"), tasks, classes.select("cid", "weight"), threshold, shingle))
    links = found.groupBy("cid").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))
    joined = common.components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")).filter("u <> v").distinct())
    known = classes.join(joined.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    names = known.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    known = known.join(names, "label").join(links, "cid", "left")
    known = known.select("sig", "label", "copy_id", "class_id", F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"), (F.coalesce("rows", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))
    return rows.select("doc_id", "key", "sig").join(known, "sig").select("doc_id", "copy_id", "class_id", "n_text_links", "n_links", "key", "label")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that with the smallest doc_id; of rows that repeat it, one. Texts without words stay.

    A class whose ids are all null keeps the row with the smallest text hash.
    """
    key = common.unused(docs, "key")
    keyed = docs.withColumn(key, common.row_key())
    blank = ~common.text_or_empty().rlike(common.WORD)
    classes = join(keyed.filter(~blank), threshold)
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("key").alias("c"))
    stays = classes.groupBy("label").agg(F.min(place).alias("first")).select(F.col("first.c").alias(key))
    kept = keyed.filter(~blank).join(stays, key, "left_semi").dropDuplicates([key])
    return kept.unionByName(keyed.filter(blank)).select(docs.columns)
