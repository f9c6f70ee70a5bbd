"""Operators on texts against brute force on awkward and on random rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import common, decontaminate, line_chunks, ngram_join, packing, rendezvous, robust_rules, seed_extend
from text_cases import AWKWARD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def near_copies(seed, n=60, size=80):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(size)) for _ in range(4)]
    out = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(5)):
            w[rng.randrange(size)] = f"z{rng.randrange(50)}"
        out.append((i if i % 9 else None, " ".join(w)))
    return out


# --- word hashes ---------------------------------------------------------------------------------------------


def test_words_are_those_of_the_pattern():
    hashes = common.WordHash()
    for _, text in AWKWARD:
        assert len(hashes.of(text)) == len(words(text))
        assert [hashes[w.encode()] for w in words(text)] == hashes.of(text).tolist()


def test_equal_runs_have_equal_hashes_wherever_they_stand():
    h = np.random.default_rng(0).integers(0, 1 << 63, 50, np.uint64)
    twice = np.concatenate([h, h[10:30], h])
    w = common.window_hashes(twice, 7)
    assert (w[10:24] == w[50:64]).all() and len(set(w[:44].tolist())) == 44
    assert (common.Prefixes(twice).of(np.array([0, 70]), np.array([50, 120]))[0] == common.Prefixes(h).of(np.array([0]), np.array([50]))[0])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    got = dict(common.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {i: 10 for i in range(10, 41)} | {k: 100 for k in range(100, 160)}
    assert common.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# --- substring repeats ---------------------------------------------------------------------------------------


def brute_substrings(rows, size):
    texts = [words(t) for _, t in rows]
    count = collections.Counter(tuple(w[k : k + size]) for w in texts for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, anchor", [(8, 3), (8, 8), (6, 1), (35, 12)])
def test_substrings(documents, window, anchor):
    rng = random.Random(window)
    rows = AWKWARD + [(i // 2, " ".join(rng.choice("ab") for _ in range(rng.choice([0, 7, 8, 9, 20, 60])))) for i in range(80)]
    got = rows_of(seed_extend.remove_repeats(documents(rows, True), window, anchor), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(rows, window)


def test_substrings_of_an_empty_table(documents):
    assert seed_extend.remove_repeats(documents([])).count() == 0


# --- line chunks ---------------------------------------------------------------------------------------------


def brute_chunks(rows):
    keys = {(i, t) for i, t in rows if t is not None}
    pieces, cuts = collections.defaultdict(list), collections.defaultdict(set)
    for i, t in keys:
        lines = [(k, x) for k, x in enumerate(t.split("\n")) if words(x)]
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for _, x in lines]
        r = [(a * 1_000_003 + b) % 2_147_483_647 for a, b in zip(h, h[1:])]
        long = [len(a[1]) + len(b[1]) >= 100 for a, b in zip(lines, lines[1:])]
        found = set()
        for j in range(len(r)):
            beside = [k for k in (j - 1, j + 1) if 0 <= k < len(r)]
            if long[j] or len(beside) < 2 or any(r[j] <= r[k] for k in beside):
                found.add((j, 2))
                found |= {(min(j, k), 3) for k in beside if r[k] > r[j] and not long[k]}
        for j, size in found:
            body = lines[j : j + size]
            pieces["\n".join(x for _, x in body)].append((i is None, i or 0, j, i, t, body[0][0], body[-1][0] + 1))
    for places in pieces.values():
        ids = {p[:2] for p in places}
        assert len({p[4] for p in places if p[:2] == min(ids)}) == 1
        for p in sorted(places, key=lambda p: p[:3])[1:]:
            cuts[p[3], p[4]] |= set(range(p[5], p[6]))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        lines = t.split("\n")
        gone = cuts.get((i, t), set())
        out.append((i, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out, key=str)


def test_line_chunks(documents):
    rng = random.Random(4)
    passage = [f"passage line {k}" for k in range(40)]
    rows = list(AWKWARD)
    for i in range(20, 60):
        own = [f"own {i} {k}" for k in range(rng.randrange(6))]
        rows.append((i, "\n".join(own + passage[rng.randrange(3) :] + own[:2])))
    df = line_chunks.remove_repeated(documents(rows, True), lines="n_lines", removed="n_removed")
    got = rows_of(df, "doc_id", "n_lines", "n_removed", "text")
    assert got == brute_chunks(rows)
    assert sum(r[2] for r in got) > 150
    assert df.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("size, wide", [(2, 30), (3, 2), (6, 12)])
def test_a_shared_passage_goes_whole_from_all_but_the_first(documents, size, wide):
    passage = [" ".join(f"p{k}x{i}" for i in range(wide)) for k in range(size)]
    rows = [(i, "\n".join([f"own {i} {k}" for k in range(i % 5)] + ["\n".join(passage)] + [f"end {i} {k}" for k in range(i % 3)])) for i in range(40)]
    got = line_chunks.remove_repeated(documents(rows), removed="gone").orderBy("doc_id").collect()
    assert [r.gone for r in got] == [0] + [size] * 39
    assert all(not set(passage) & set(r.text.split("\n")) for r in got[1:])


def test_lines_without_words_neither_part_nor_make_a_run(documents):
    rows = [(1, "one a\ntwo b\nthree c\n\n \nx"), (2, "y\none a\n\ntwo b\n\t\nthree c\n\n \nz")]
    got = dict(line_chunks.remove_repeated(documents(rows)).select("doc_id", "text").collect())
    assert got == {1: rows[0][1], 2: "y\n\n \nz"}


def test_texts_under_one_hash_are_told_apart(documents, monkeypatch):
    monkeypatch.setattr(line_chunks.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    monkeypatch.setattr(line_chunks.common, "row_key", lambda: F.col("doc_id"))
    rows = [(i, "\n".join(["shared a", "shared b", "shared c"][: 3 * (i % 2)] + [f"own {i} {k}" for k in range(3)])) for i in range(8)]
    assert rows_of(line_chunks.remove_repeated(documents(rows), lines="a", removed="b"), "doc_id", "a", "b", "text") == brute_chunks(rows)


def test_line_chunks_of_an_empty_table(documents):
    assert line_chunks.remove_repeated(documents([])).count() == 0


# --- n-gram join ---------------------------------------------------------------------------------------------


def brute_join(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, texts = [], []
    for i, a in enumerate(sets):
        hit = [j for j, b in enumerate(sets) if j != i and (a == b or (a and b and len(a & b) / len(a | b) >= threshold))]
        links.append(len(hit))
        texts.append(len({sets[j] for j in hit} - {a}))
        for j in hit:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    low = lambda v: min((x for x in v if x is not None), default=None)
    return sorted(
        (
            (
                rows[i][0],
                low(r[0] for r, s in zip(rows, sets) if s == sets[i]),
                low(r[0] for j, r in enumerate(rows) if root(j) == root(i)),
                texts[i],
                links[i],
            )
            for i in range(len(rows))
        ),
        key=str,
    )


@pytest.mark.parametrize("unit", [400_000, 900])
def test_join(documents, unit):
    rows = AWKWARD + [(None if i is None else i + 100, t) for i, t in near_copies(1)]
    got = rows_of(ngram_join.join(documents(rows, True), unit=unit), "doc_id", "copy_id", "class_id", "n_text_links", "n_links")
    assert got == brute_join(rows)


def test_prefixes_shorten_until_the_recall_is_met():
    for trees in (1, 8, 64):
        d = ngram_join.prefix_depth(trees, 12, 0.8, 0.99)
        met = lambda k: 1 - (1 - 0.8**k) ** trees >= 0.99
        assert (met(d) or d == 1) and not (d < 12 and met(d + 1))


def test_one_of_each_class_stays(documents):
    rows = AWKWARD + [(None if i is None else i + 100, t) for i, t in near_copies(2)]
    kept = ngram_join.keep_first(documents(rows, True))
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    worded = [(i, t) for i, t in rows if words(t)]
    classes = collections.defaultdict(list)
    for row, found in zip(sorted(worded, key=str), range(len(worded))):
        classes[found] = row
    assert all(got[(i, t)] == rows.count((i, t)) for i, t in rows if not words(t))
    stays = [r for r in got.elements() if words(r[1])]
    assert len(stays) == len({r for r in stays})
    alone = ngram_join.join(documents([(i, t) for i, (_, t) in enumerate(stays)]))
    assert alone.filter("n_links > 0").count() == 0
    full = ngram_join.join(documents([(i, t) for i, (_, t) in enumerate(worded)]))
    assert len(stays) == full.select("class_id").distinct().count()
    assert ngram_join.join(documents([])).count() == 0 and ngram_join.keep_first(documents([])).count() == 0


# --- benchmark leaks -----------------------------------------------------------------------------------------


def normal(text):
    return [w for w in (re.sub(r"[^\w\s]|_", "", x.lower()) for x in words(text)) if w]


def brute_leaks(docs, items, contained=0.8):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [normal(t)] for i in range(len(w) - 4)}
    out = []
    for i, t in docs:
        a = grams(t)
        for k, u in items:
            b = grams(u)
            if b and len(a & b) / len(b) >= contained:
                out.append((i, k, len(a & b), len(b)))
    return sorted(out, key=str)


def test_leaks(spark, documents):
    rng = random.Random(6)
    text = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([3, 5, 6, 9, 12, 14, 40, 60, 200])] + [(20, None), (None, "an item of six plain words"), (21, ""), (6, "an item of six plain words")]
    docs = list(AWKWARD)
    for n in (10, 300, 5000, 40_000):
        for k, u in items:
            if u:
                w = text(n).split()
                at = rng.randrange(len(w))
                cut = u.upper().split()
                if rng.random() < 0.3:
                    cut[rng.randrange(len(cut))] = "changed"
                docs.append((len(docs) + 100, " ".join(w[:at] + ["(" + cut[0], *cut[1:]] + w[at:])))
    docs.append((None, items[6][1]))
    table = spark.createDataFrame([(k, u, "x") for k, u in items], "item_id bigint, text string, key string")
    got = rows_of(decontaminate.leaks(documents(docs, True), table), "doc_id", "item_id", "n_shared", "n_item")
    want = brute_leaks(docs, items)
    assert got == want and len(want) > 25
    clean = decontaminate.drop_leaks(documents(docs), table)
    found = {i for i, *_ in want}
    assert rows_of(clean, "doc_id", "text") == sorted(((i, t) for i, t in docs if i not in found or not brute_leaks([(i, t)], items)), key=str)
    assert decontaminate.leaks(documents([]), table).count() == 0
    assert decontaminate.leaks(documents(docs), table.limit(0)).count() == 0


# --- rules ---------------------------------------------------------------------------------------------------


def brute_base(text):
    w = words(text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(three)
    hit = {i + k for i, g in enumerate(three) if count[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n, rep = len(w), len(hit)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def test_rules(documents):
    rng = random.Random(8)
    good = [(i, "\n".join(" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(8, 15))).capitalize() + "." for _ in range(9))) for i in range(100, 400)]
    bad = [(i, t.replace(" ", "*** ").upper()) for i, t in good[:6]]
    bad = [(i + 900, t) for i, t in bad]
    rows = AWKWARD + good + bad
    got = robust_rules.judge(documents(rows, True)).collect()
    base = sorted((r[0], r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got if r[0] is not None)
    assert base == sorted((i, *brute_base(t)) for i, t in rows if i is not None)
    kept = {r.doc_id for r in got if r.kept}
    assert {i for i, _ in good} <= kept and not kept & {i for i, _ in bad}
    assert all(r.kept is False for r in got if r.base_failed)
    left = robust_rules.filter_documents(documents(rows, True))
    assert left.count() == sum(r.kept for r in got) and left.columns[:3] == ["doc_id", "text", "lang"]
    assert robust_rules.judge(documents([])).count() == 0


def test_small_groups_borrow_smoothly():
    own, wider = np.array([1.0, 5.0]), np.array([3.0, 5.0])
    at = [robust_rules.shrunk(n, own, wider) for n in range(1, 5000)]
    assert all((abs(a - b) < 0.011).all() for a, b in zip(at, at[1:])) and (at[0] > 2.98)[0] and (at[-1] < 1.1)[0]
    assert all(a[1] == pytest.approx(5) for a in at)


def test_groups_of_any_size_are_judged_by_their_own_estimate(spark, documents):
    rng = random.Random(2)

    def text(caps):
        return " ".join("".join(rng.choice("abcdef") for _ in range(5)).upper() if rng.random() < caps else f"w{rng.randrange(10**6)}" for _ in range(120))

    rows = [(i, text(0.0)) for i in range(400)] + [(i, text(0.9)) for i in range(400, 520)]
    source = F.when(F.col("doc_id") < 400, "plain").otherwise("loud")
    docs = documents(rows).withColumn("source", source)
    got = {r.doc_id: r.distance for r in robust_rules.judge(docs).collect()}
    loud, as_plain = [got[i] for i in range(400, 520)], robust_rules.judge(docs.withColumn("source", F.lit("plain"))).filter("doc_id >= 400").collect()
    assert np.median(loud) < np.median([r.distance for r in as_plain]) / 2


# --- sharding ------------------------------------------------------------------------------------------------


def test_shards(documents):
    rows = AWKWARD + [(i, f"text {i % 7}") for i in range(50, 1500)]
    got = rendezvous.assign(documents(rows, True), [1.0] * 8, [1.0] * 9).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert set(slots) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    moved = sum(r.grown_shard == 8 for r in got) / len(got)
    assert 0.07 < moved < 0.16
    assert rendezvous.assign(documents([]), [1.0, 2.0]).count() == 0


def test_shards_follow_their_weights(documents, tmp_path):
    df = documents([(i, "x") for i in range(4000)])
    share = dict(df.groupBy(rendezvous.shard_column(F.col("doc_id"), [1.0, 3.0, 0.0]).alias("s")).count().collect())
    assert set(share) == {0, 1} and 0.70 < share[1] / 4000 < 0.80
    rendezvous.write_shards(df, str(tmp_path / "out"), [1.0, 3.0])
    assert df.sparkSession.read.parquet(str(tmp_path / "out")).count() == 4000
    with pytest.raises(ValueError):
        rendezvous.shard_column(F.col("doc_id"), [0.0])


# --- packing -------------------------------------------------------------------------------------------------

TOKENIZERS = pytest.importorskip("public_tokenizers")


def brute_pieces(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZERS.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    out = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        start, k = 0, 0
        while start < len(ids):
            n = (len(ids) - start - 1) % 1024 + 1
            out.append((i, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            start, k = start + n, k + 1
    return sorted(out, key=str)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_ids_of_tokenizers(name):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(TOKENIZERS.path(name))
    slow.encode_special_tokens = True
    encoder = packing.Encoder(TOKENIZERS.path(name))
    assert (encoder.fast is not None) == (name == "byte_bpe_50k.json")
    texts = [t or "" for _, t in AWKWARD] + ["a" * 9000, "don't we'll  \n\n x  ", " lead", "trail ", "\r\n 　x", "数字123٣x²", "a\n \nb"]
    for t in texts:
        assert encoder.ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_packing(documents):
    rng = random.Random(9)
    rows = AWKWARD + [(i, " ".join("word" for _ in range(rng.randrange(1, 1500)))) for i in range(100, 400)]
    packed = packing.pack_documents(documents(rows, True), TOKENIZERS.path("byte_bpe_50k.json"), with_ids=True)
    got = packed.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == brute_pieces(rows)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(r.length for r in got) // 1024)
    assert len(bins) <= least * 1.02 + 1
    whole = {r.sequence_id: len(r.ids) for r in packing.sequences(packed).collect()}
    assert whole == {k: sum(n for _, n in v) for k, v in bins.items()}
    assert packing.pack_documents(documents([]), TOKENIZERS.path("byte_bpe_50k.json")).count() == 0


def test_rounds_open_the_worst_bins_again(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 64)
    rng = random.Random(3)
    sizes = [rng.randrange(1, 101) for _ in range(1500)]
    items = spark.createDataFrame(list(enumerate(sizes)), "uid bigint, length bigint")
    got = packing.pack(items, 100).collect()
    assert sorted(r.uid for r in got) == list(range(1500))
    fill = collections.Counter()
    for r in got:
        fill[r.sequence_id] += sizes[r.uid]
    assert max(fill.values()) <= 100 and len(fill) <= -(-sum(sizes) // 100) * 1.06


def test_evolution_never_loses_to_its_start():
    rng = np.random.default_rng(5)
    lengths = rng.integers(200, 700, 400)
    start = packing.evolve(lengths, 1024, 1, [], generations=0, population=1)
    best = packing.evolve(lengths, 1024, 1, start, generations=10)[0]
    count = lambda b: len(np.unique(b))
    assert count(best) <= count(start[0])
    assert np.bincount(best, lengths).max() <= 1024 and len(best) == 400
