"""Merkle manifest, source mixing and spelling variants against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cohortlake.llm import balance, common, merkle, spelling
from text_cases import AWKWARD


def table(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, "en" if i else None, s, None if t is None else len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if extra:
        for name in ("tree", "idx", "n", "digest", "carry", "size", "place", "of", "part", "at", "tie", "key", "word", "run", "h", "copies"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def plain(rows, columns):
    return sorted(([tuple(r[c] for c in columns) for r in rows]), key=str)


# --- places --------------------------------------------------------------------------------------------------


def test_places_are_ranks_of_their_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "b", "b"]), rng.randrange(40), k) for k in range(900)]
    df = common.stage(spark.createDataFrame(rows, "g string, v int, k int").repartition(7))
    details = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "g string, d int")
    got = collections.defaultdict(list)
    for r in common.numbered(df, ["g"], [df["v"]], details).collect():
        got[r.g].append((r.place, r.v, r.of, r.d))
    for g, found in got.items():
        own = sorted(v for x, v, _ in rows if x == g)
        assert sorted(found) == [(k, v, len(own), {"a": 1, "b": 2, None: 3}[g]) for k, v in enumerate(own)]
    assert common.numbered(df.limit(0), ["g"], [df["v"]]).count() == 0


# --- manifest ------------------------------------------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows, fan=16):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(i, t, s, changed=False):
        if changed and t is not None:
            t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        return digest("".join(map(one, (i, s, "en" if i else None, None if t is None else len(t), t)))) if not changed else digest(
            one(i) + one(s) + one("en" if i else None) + one(None if t is None else len(t)) + one(t)
        )

    def grow(nodes):
        steps = [[] for _ in nodes]
        of = list(range(len(nodes)))
        while len(nodes) > 1:
            for k, at in enumerate(of):
                run = nodes[at - at % fan : at - at % fan + fan]
                steps[k].append((run[: at % fan], run[at % fan + 1 :]))
            nodes = [digest("".join(nodes[a : a + fan])) for a in range(0, len(nodes), fan)]
            of = [at // fan for at in of]
        return nodes[0], steps

    groups = collections.defaultdict(list)
    for i, t, s in rows:
        groups[s].append((i is not None, i or 0, leaf(i, t, s), i, t))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [grow([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in names]
    root, tops = grow([t[0] for t in trees])
    out = []
    for s, (subroot, steps), top in zip(names, trees, tops):
        for (_, _, h, i, t), path in zip(sorted(groups[s], key=lambda r: r[:3]), steps):
            path = path + top
            hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
            own = leaf(i, t, s, True) if hit else h
            for before, after in path:
                own = digest("".join(before) + own + "".join(after))
            proof = digest("".join("".join(b) + "".join(a) for b, a in path))
            out.append((i, h, subroot, root, proof, own, own == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("fan", [16, 2])
def test_manifest(spark, fan):
    rng = random.Random(fan)
    rows = [(i, t, s) for (i, t), s in zip(AWKWARD, ["", None, "b", "a", "a"] * 9)]
    rows += [(k, f"Text {k % 9} with Capitals", rng.choice(["a", "a", "é", f"s{k % 37}"])) for k in range(400 if fan > 2 else 40)]
    rows += [(7, "Same", "only")]
    got = merkle.manifest(table(spark, rows), fan).collect()
    want = brute_manifest(rows, fan)
    assert plain(got, COLUMNS) == want
    assert {r.verified for r in got} == {True, False}
    with pytest.raises(AssertionError):  # a changed row changes the root
        assert plain(merkle.manifest(table(spark, [(1, "x", "a"), *rows[1:]]), fan).collect(), COLUMNS) == want


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(k, f"T{k}", "a") for k in range(n)]
    got = plain(merkle.manifest(table(spark, rows, False)).collect(), COLUMNS)
    assert got == (brute_manifest(rows) if n else [])


# --- mixing --------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = goal - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def brute_rates(sizes, target):
    """Bisection for the multiplier of one source."""
    x = np.array(sizes, float)
    low, high = -60.0, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        if (x * np.minimum(2, np.exp(np.minimum(mid * x, 50)))).sum() < target:
            low = mid
        else:
            high = mid
    return mid


def mixing_rows(seed):
    rng = random.Random(seed)
    rows = [(i, t, s) for (i, t), s in zip(AWKWARD, ["s0", None, "s3", "s1", "s0"] * 9)]
    for k in range(100, 1300):
        s = rng.choice(["s0", "s0", "s0", "s1", "s2", "s3", "s4", None])
        rows.append((k, "w " * (37 if k % 3 == 0 else int(rng.lognormvariate(3, 1))), s))
    return rows + [(5000, "", "empty"), (5001, None, "empty")]


def test_mix(spark):
    rows = mixing_rows(3)
    got = balance.mix(table(spark, rows)).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert plain(got, ("doc_id", "size")) == sorted(((i, words(t)) for i, t, _ in rows), key=str)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want = brute_targets(sizes)
    of = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size + r.part
        if r.doc_id is not None and r.doc_id >= 100:
            s = of[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-12)
    assert sum(r.part != 0 for r in got) <= len(sizes)
    for r in got:
        taken[r.target] += r.taken
    for s, goal in want.items():
        near = [v for k, v in taken.items() if abs(k - goal) < 1e-6]
        assert near and abs(near[0] - goal) <= 1
    assert plain(got, ("doc_id", "taken")) == plain(balance.mix(table(spark, rows[::-1]).repartition(5)).collect(), ("doc_id", "taken"))
    assert balance.mix(table(spark, [])).count() == 0


def test_multipliers_solve_the_dual(spark):
    rng = random.Random(5)
    sizes = {s: [int(rng.lognormvariate(5, 1.2)) + 1 for _ in range(400)] for s in ("a", "b", "c")}
    goals = {"a": 0.3, "b": 1.0, "c": 1.7}
    counts = [(s, v, n) for s, own in sizes.items() for v, n in collections.Counter(own).items()]
    sources = [(s, float(goals[s] * sum(own)), sum(own)) for s, own in sizes.items()]
    got = balance.multipliers(spark.createDataFrame(counts, "source string, size bigint, n bigint"), spark.createDataFrame(sources, "source string, target double, source_size bigint"))
    for r in got.collect():
        x = np.array(sizes[r.source]) / r.scale
        taken = (x * r.scale * np.minimum(2, np.exp(r.multiplier * x))).sum()
        assert taken == pytest.approx(goals[r.source] * sum(sizes[r.source]), rel=1e-5)
        assert r.multiplier == pytest.approx(brute_rates(x, goals[r.source] * x.sum()), abs=1e-3)


# --- spelling ------------------------------------------------------------------------------------------------


def brute_words(rows, least=6, times=5):
    n = collections.Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= times}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute_forms(n):
    out, form = [], {}
    for w, k in n.items():
        hits = [x for x in n if near(w, x)]
        best = min(hits, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 5 * k:
            form[w] = best
        out.append((w, k, len(hits)))
    root = lambda w: root(form[w]) if w in form else w
    return sorted(((w, form.get(w), root(w), k, m, n[form[w]] if w in form else None) for w, k, m in out), key=str)


FORMS = ("word", "form", "root", "n", "n_near", "form_n")


def edited(rng, w, letters):
    at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
    return w[:at] + (rng.choice(letters) if kind < 2 else "") + w[at + (kind > 0) :]


@pytest.mark.parametrize("letters, frequent", [("ab", 1), ("ab", 64), ("abcdeé", 3)])
def test_near_pairs(spark, letters, frequent):
    rng = random.Random(len(letters) + frequent)
    some = {"".join(rng.choice(letters) for _ in range(rng.choice([6, 6, 7, 8, 12]))) for _ in range(150)}
    some |= {e for w in sorted(some) for e in (edited(rng, w, letters), edited(rng, w, letters)) if len(e) >= 6} | {"a" * 300, "a" * 301}
    n = {w: rng.choice([5, 5, 30, 400]) for w in sorted(some)}
    got = spelling.near_pairs(spark.createDataFrame(list(n.items()), "word string, n bigint"), frequent=frequent)
    assert plain(got.collect(), ("word", "other")) == sorted(((a, b) for a in n for b in n if near(a, b)), key=str)


def test_forms_follow_chains(spark):
    n = {"abcdefg": 5, "abcdefgh": 25, "abcdefghi": 125, "abcdefghij": 700, "abcdefgx": 25, "zzzzzz": 9}
    got = spelling.forms(spark.createDataFrame(list(n.items()), "word string, n bigint"))
    assert plain(got.collect(), FORMS) == brute_forms(n)


def test_variants(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(6, 10))) for _ in range(60)] + ["Éclairé", "naïveté", "ÀÉÎÕÜß", "x" * 400]
    rows = [(i, t, "s") for i, t in AWKWARD]
    for k in range(300):
        words = [rng.choice(base) if rng.random() < 0.9 else edited(rng, base[rng.randrange(5)], "ae") for _ in range(rng.randrange(200))]
        rows.append((None if k % 50 == 0 else k, "1".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words) + "_x", "s"))
    got = spelling.variants(table(spark, rows))
    want = brute_forms(brute_words(rows))
    assert plain(got.collect(), FORMS) == want and sum(r[1] is not None for r in want) > 20
    assert spelling.variants(table(spark, [])).count() == 0
