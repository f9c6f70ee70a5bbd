"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Pieces are dealt at random into blocks of bounded size. Several islands evolve packings of each block: crossover
injects whole well-filled bins of one parent into the other, removes the bins that hold the same pieces, and
best-fits the displaced pieces. Between epochs the best packings of an island migrate to its neighbour. The worst
few bins of every block are opened again and packed together in a next, far smaller round, until one block is left.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortlake.llm import common

LENGTH = 1024
END_ID = 2
BLOCK = 4096  # pieces of a block, on average
TASKS = 20_000  # tasks that islands are dealt to at most; beyond it a task takes several, one after another
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
OPENED = 0.02  # of a block's bins that the next round may pack anew
LONG_WORD = 4096  # characters without white space beyond which the slower, never quadratic encoder is used


class Encoder:
    """Token ids of a byte-level BPE file of the ``tokenizers`` library, special tokens' strings being plain text.

    With ``added``, the ids are those of the file as ``tokenizers`` loads it: the content of an added token is that
    token, and texts that hold one go through ``tokenizers``.

    Where ids are in the order of the merges, as byte-level BPE files have them, ranks say the same as merges, and
    the ids are computed by ``tiktoken`` from the file's own vocabulary, about four times as fast. Any other file,
    and texts with very long words, go through ``tokenizers``.
    """

    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = not added
        self.fast = None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec.get("added_tokens") or []] if added else []
        steps, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = spec.get("normalizer") is None and steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and steps.get("use_regex", True)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        made = [model["vocab"].get(a + b, -1) for a, b in merges]
        if plain and model.get("type", "BPE") == "BPE" and made == list(range(256, 256 + len(made))):
            import tiktoken

            printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            other = [b for b in range(256) if b not in set(printed)]  # bytes without a printed form stand at 256 and on
            byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(other)}
            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(made)}
            self.fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not any(t in text for t in self.added) and (len(text) <= LONG_WORD or not re.search(r"\S{%d}" % LONG_WORD, text)):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END_ID, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Each row's token ids and ``end``, cut from the back into pieces of ``length``; the first may be shorter.

    A null text is an empty one: the single id ``end``. Rows that repeat are documents of their own.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
        encoder = Encoder(tokenizer, added)
        for batch in batches:
            rows, of = [], []
            for row, text in enumerate(batch["text"]):
                ids = np.append(encoder.ids(text), np.array([end], "<u4"))
                first = (len(ids) - 1) % length + 1
                bounds = [0, *range(first, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    data = ids[a:b].tobytes()
                    rows.append((k, a, b - a, zlib.crc32(data)) + (data,) * with_ids)
                    of.append(row)
            yield np.array(of, np.int64), pd.DataFrame(rows, columns=names)

    kinds = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [k.split()[0] for k in kinds.split(", ")]
    return common.map_beside(docs.select("doc_id", common.text_or_empty().alias("text")), ["doc_id"], cut, kinds)


class _Packing:
    """Bins of one block: ``bin`` of each piece and the filled length of each bin."""

    def __init__(self, bins: np.ndarray, fill: list[int], capacity: int):
        self.bins, self.fill, self.capacity = bins, fill, capacity

    def key(self) -> tuple[int, float]:
        """Fewer bins first, then the larger sum of squared fills, which rewards full bins beside open ones."""
        f = np.asarray(self.fill, float) / self.capacity
        return len(self.fill), -float((f * f).sum())


def _best_fit(bins: np.ndarray, fill: list[int], order: np.ndarray, lengths: list[int], capacity: int) -> None:
    """Put pieces, in ``order``, where least room is left, or into new bins. Bits of ``open_`` mark rooms with bins."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for b, f in enumerate(fill):
        if f < capacity:
            room[capacity - f].append(b)
            open_ |= 1 << (capacity - f)
    for i in order.tolist():
        n = lengths[i]
        fitting = open_ >> n
        if fitting:
            r = (fitting & -fitting).bit_length() - 1 + n
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        fill[b] += n
        bins[i] = b
        if r > n:
            room[r - n].append(b)
            open_ |= 1 << (r - n)


def _rebuilt(bins: np.ndarray, freed: np.ndarray, lengths: np.ndarray, listed: list[int], capacity: int, order: np.ndarray) -> _Packing:
    """Renumber the bins of pieces that aren't ``freed``, then best-fit the freed ones in ``order``."""
    new = np.full(len(bins), -1, np.int64)
    held = ~freed
    if held.any():
        _, new[held] = np.unique(bins[held], return_inverse=True)
    fill = np.bincount(new[held], lengths[held]).astype(int).tolist() if held.any() else []
    _best_fit(new, fill, order, listed, capacity)
    return _Packing(new, fill, capacity)


def _crossed(a: _Packing, b: _Packing, lengths: np.ndarray, listed: list[int], random: np.random.Generator) -> _Packing:
    """``a`` with some of ``b``'s well-filled bins in it."""
    fill = np.asarray(b.fill)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[random.choice(good, max(1, len(good) // 4), replace=False)] = True
    injected = chosen[b.bins]
    hit = np.zeros(len(a.fill), bool)
    hit[a.bins[injected]] = True
    # Also open the emptiest bins of a, or nothing could ever leave them.
    hit[np.argsort(a.fill)[: 1 + len(a.fill) // 50]] = True
    freed = hit[a.bins] & ~injected
    mixed = np.where(injected, len(a.fill) + b.bins, a.bins)
    order = np.flatnonzero(freed)
    order = order[np.argsort(-lengths[order] + random.normal(0, 2, len(order)), kind="stable")]
    return _rebuilt(mixed, freed, lengths, listed, a.capacity, order)


def evolve(lengths: np.ndarray, capacity: int, seed: int, start: list[np.ndarray], generations: int = GENERATIONS, population: int = POPULATION) -> list[np.ndarray]:
    """The best packings of one island after some generations, as the bin of each piece; the best one first.

    ``start`` holds packings to go on with. Evolution ends early at the least number of bins there can be.
    """
    random = np.random.default_rng(seed)
    listed = lengths.tolist()
    least = -(-int(lengths.sum()) // capacity)
    all_free = np.ones(len(lengths), bool)
    group = [_Packing(s, np.bincount(s, lengths).astype(int).tolist(), capacity) for s in start]
    while len(group) < population:
        noise = 0 if not group else random.normal(0, 8 * len(group), len(lengths))
        order = np.argsort(-lengths + noise, kind="stable")
        group.append(_rebuilt(np.zeros(len(lengths), np.int64), all_free, lengths, listed, capacity, order))
        if len(group[-1].fill) == least:
            break
    group.sort(key=_Packing.key)
    for _ in range(generations):
        if len(group[0].fill) == least:
            break
        children = []
        for _ in range(population):
            i, j = random.integers(0, len(group), 2)
            children.append(_crossed(group[i], group[j], lengths, listed, random))
        group = sorted(group + children, key=_Packing.key)[:population]
    return [g.bins for g in group]


def _round(rest: DataFrame, blocks: int, number: int, capacity: int) -> DataFrame:
    """(uid, length, sequence_id, offset, open) of one round over ``rest(uid, length)``."""
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(blocks)))
    gathered = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "uid"))).alias("items"))  # BLOCK pieces or so
    state = gathered.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("items.length").alias("lengths"), F.array().cast("array<binary>").alias("packings"))

    islands = min(blocks * ISLANDS, TASKS)  # a number of its own keeps adaptive execution from merging islands into one task
    for epoch in range(EPOCHS):

        def advance(batches: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for x in batch.itertuples(index=False):
                    start = [np.frombuffer(p, np.int32).astype(np.int64) for p in x.packings]
                    best = evolve(np.asarray(x.lengths, np.int64), capacity, (number * 97 + epoch * 31 + x.island) * 1_000_003 + x.block, start)
                    yield pd.DataFrame({"block": [x.block], "island": [x.island], "lengths": [x.lengths], "packings": [[b.astype(np.int32).tobytes() for b in best]]})

        at = F.pmod(F.col("block") * ISLANDS + F.col("island"), F.lit(islands)).cast("int")
        state = common.stage(state.repartitionById(islands, at).mapInPandas(advance, state.schema))
        elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("packings", 1, 2).alias("elite"))
        state = state.join(elite, ["block", "island"]).select("block", "island", "lengths", F.concat(F.col("elite"), F.slice("packings", 1, 2)).alias("packings"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples(index=False):
                lengths = np.array([i["length"] for i in x.items], np.int64)
                found = [_Packing(b, np.bincount(b, lengths).astype(int).tolist(), capacity) for b in (np.frombuffer(p, np.int32) for p in x.packings)]
                best = min(found, key=_Packing.key)
                order = np.argsort(best.bins, kind="stable")
                ends = np.cumsum(lengths[order])
                fill = np.asarray(best.fill)
                offset = ends - lengths[order] - np.repeat(np.cumsum(fill) - fill, np.bincount(best.bins))
                opened = np.zeros(len(fill), bool)
                opened[np.argsort(fill, kind="stable")[: max(1, int(len(fill) * OPENED))]] = True
                bins = best.bins[order].astype(np.int64)
                yield pd.DataFrame({"uid": np.array([i["uid"] for i in x.items], np.int64)[order], "length": lengths[order], "sequence_id": (np.int64(number) << 56) | (np.int64(x.block) << 24) | bins, "offset": offset, "open": opened[bins]})

    packings = state.groupBy("block").agg(F.flatten(F.collect_list("packings")).alias("packings"))
    ready = gathered.join(packings, "block").select("block", "items", "packings")
    ready = ready.repartitionById(min(blocks, TASKS), F.pmod("block", F.lit(min(blocks, TASKS))).cast("int"))
    return ready.mapInPandas(placed, "uid long, length long, sequence_id long, offset long, open boolean")


def pack(items: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """(uid, sequence_id, offset) for ``items(uid, length)``, uids distinct and lengths from 1 to ``capacity``."""
    full = items.filter(F.col("length") == capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, number = items.filter(F.col("length") < capacity).select("uid", "length"), full, 0
    while count := rest.count():
        blocks = max(1, count // BLOCK)
        placed = common.stage(_round(rest, blocks, number, capacity))
        closed = placed if blocks == 1 else placed.filter("not open")
        done = done.union(closed.select("uid", "sequence_id", "offset"))
        if blocks == 1:
            break
        rest, number = placed.filter("open").select("uid", "length"), number + 1
    return done


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END_ID, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Each piece of each document with its sequence and offset. An empty table has no pieces."""
    cut = common.stage(pieces(docs, tokenizer, length, end, with_ids, added).withColumn("uid", F.monotonically_increasing_id()))
    return cut.join(pack(cut.select("uid", "length"), length), "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, from pieces packed ``with_ids``; one sequence is one group."""
    ordered = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(p["ids"], "<u4") for p in parts]).astype(np.int64) for parts in batch["parts"]]
            yield pd.DataFrame({"sequence_id": batch["sequence_id"], "ids": ids})

    return ordered.mapInPandas(joined, "sequence_id long, ids array<int>")
