"""Hard negatives, SetSketch near-duplicates and the prefix trie against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docketry.llm import bond, prefix_trie, scans, setsketch

LOWER = {c: c + 32 for c in range(65, 91)}


# Hard negatives


VECTORS = "vec_id long, embedding array<float>, label int, id long, part int, score double, vec string"


def vectors():
    rnd = random.Random(5)
    rows = [(i if i % 41 else None, [rnd.gauss(0, 0.3) for _ in range(rnd.choice([8, 8, 8, 5]))], rnd.randint(0, 2), 1, 2, 3.0, "x") for i in range(420)]
    rows += [(100, [0.5] * 8, 1, 1, 2, 3.0, "x"), (100, [0.5] * 8, 1, 1, 2, 3.0, "x"), (200, [], 0, 1, 2, 3.0, "x"), (300, [0.0] * 8, 2, 1, 2, 3.0, "x"), (-100, [1e30, -1e30] + [0.1] * 6, 0, 1, 2, 3.0, "x")]
    rows += [(i, [0.25] * 8, i % 3, 1, 2, 3.0, "x") for i in range(1000, 1040)]  # ties
    rows += [(5, None, 1, 1, 2, 3.0, "x"), (7, [0.1, None], 1, 1, 2, 3.0, "x"), (400, [float("nan")], 1, 1, 2, 3.0, "x"), (500, [float("inf")], 1, 1, 2, 3.0, "x"), (600, [0.1], None, 1, 2, 3.0, "x"), (None, [0.3] * 8, 1, 1, 2, 3.0, "x")]
    return rows


def negatives_by_force(rows, low=30, high=90):
    kept = []
    for vec_id, vector, label, *_ in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [max(-(1 << 26), min(1 << 26, math.floor(256 * float(np.float32(x))))) for x in vector], label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for at, (anchor, a, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a, v, strict=False)), i, other) for k, (i, v, other) in enumerate(kept) if k != at]
        for positive, pid in [(s, i) for s, i, other in sorted(scored, key=order) if other == label][:5]:
            fit = [x for x in sorted(scored, key=order) if x[2] != label and low * positive <= 100 * x[0] <= high * positive][:10]
            out += [(anchor, pid, rank, i, positive, s) for rank, (s, i, _) in enumerate(fit, 1)]
    return out


def ordered(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize(("part_rows", "block"), [(bond.PART_ROWS, bond.BLOCK), (64, 32)])
def test_hard_negatives(spark, monkeypatch, part_rows, block):
    monkeypatch.setattr(bond, "BLOCK", block)
    got = bond.hard_negatives(spark.createDataFrame(vectors(), VECTORS).repartition(3), part_rows=part_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert ordered(map(tuple, got.collect())) == ordered(negatives_by_force(vectors()))


def test_hard_negatives_of_nothing(spark):
    assert bond.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert bond.hard_negatives(spark.createDataFrame([(1, [0.1], 1, 1, 1, 1.0, "x")], VECTORS)).count() == 0


def test_bounds_shrink_the_bitmap(spark):
    """A row that can't reach the best scores is dropped before its last dimensions are read."""
    rnd = np.random.Generator(np.random.PCG64(1))
    values = rnd.integers(-100, 100, (500, 32))
    values[:5] *= 8

    class Counted(list):
        read = 0

        def __getitem__(self, d):
            column = super().__getitem__(d)

            class Column(np.ndarray):
                def __getitem__(self, which):
                    Counted.read += np.size(which)
                    return np.asarray(self)[which]

            return column.view(Column)

    block = bond.Block({"ids": np.arange(500, dtype="<i8").tobytes(), "unnamed": bytes(500), "labels": bytes(4000), "columns": [c.astype("<i4").tobytes() for c in values.T], "least": values.min(0).tolist(), "largest": values.max(0).tolist()})
    block.columns = Counted(block.columns)
    anchor = np.sort(rnd.integers(1, 100, 32))[::-1] ** 3
    best = bond.Best(3)
    bond.scan(block, anchor, np.arange(499), [(None, None, best)])
    whole = values[:499] @ anchor
    assert best.scores.tolist() == sorted(whole.tolist(), reverse=True)[:3]
    assert Counted.read < 499 * 32 * 0.8


# SetSketch


DOCS = "doc_id long, text string, id long, digest string, n int, key long, nid long"


def near_texts():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    out = [None, "", " \t\n", "", "one", "One", "two three", "two  three"]
    for _ in range(25):
        base = prose(rnd.randint(5, 160))
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 30))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append(" ".join(copy).upper() if rnd.random() < 0.2 else " ".join(copy))
    hub = prose(200)
    for i in range(60):  # a group in which most pairs are near and some aren't
        copy = list(hub)
        for _ in range(i % 6):
            copy[rnd.randrange(200)] = rnd.choice(words)
        out.append(" ".join(copy))
    return [*out, *out[20:40], " ".join(prose(30_000)), "a b c d a b c d a b c d"]


def components_by_force(rows, shingle, similar):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= similar * (len(sets[a]) + len(sets[b]) - same):
                root[find(a)] = find(b)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return [(doc_id, len(sets[i]), least[find(i)], doc_id == least[find(i)]) for i, (doc_id, _) in enumerate(rows)]


@pytest.mark.parametrize(("shingle", "similar"), [(4, 80), (2, 60)])
def test_near_sets(spark, shingle, similar):
    rows = [(i * 7 % 501 if i % 11 else None, t) for i, t in enumerate(near_texts())] + [(3, "x y z u v w"), (3, "x y z u v w"), (3, "quite another text here it is")]
    docs = spark.createDataFrame([(i, t, 1, "d", 2, 3, 4) for i, t in rows], DOCS).repartition(3)
    got = setsketch.near_sets(docs, shingle=shingle, similar=similar)
    assert ordered(map(tuple, got.collect())) == ordered(components_by_force(rows, shingle, similar))


def test_near_sets_of_nothing(spark):
    assert setsketch.near_sets(spark.createDataFrame([], DOCS)).count() == 0


def test_registers_merge_and_estimate():
    rnd = np.random.Generator(np.random.PCG64(2))
    pool = rnd.integers(0, 1 << 63, 3000, np.uint64)
    one, two = pool[:2000], pool[500:2600]
    cuts = np.array([0, 2000, 4100])
    a, b = setsketch.registers(np.concatenate([one, two]), cuts)
    assert (setsketch.merged(a, b) == setsketch.registers(np.union1d(one, two), np.array([0, 2600]))[0]).all()
    scale = setsketch.BASE ** -a.astype(float)
    assert abs(setsketch.REGISTERS / (setsketch.RATE * scale.sum()) / 2000 - 1) < 0.3  # the mean register tells the size
    j = setsketch.estimate(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([2000.0]), np.array([2100.0]))[0]
    assert abs(j - 1500 / 2600) < 0.15


# Prefix trie


TURNS = "conv_id long, turn long, role string, text string, key string, depth int, n_convs long"


def conversations():
    rnd = random.Random(9)
    said = ["hi", "", None, "hello élan", "how are you " * 40, "no", "yes"]
    rows = []
    for c in [*range(60), -7, -5, 10**12, 10**12 + 2]:
        if c % 13 == 4:
            continue
        for t in range(rnd.choice([0, 1, 1, 2, 3, 5, 9, 12])):
            rows.append((c, t if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", None]) if t > 2 else "user", rnd.choice(said[: 2 + t])))
    rows += [(200, t, "user", "long") for t in range(300)] + [(c, 0, "user", "hi") for c in range(300, 420)] + [(None, 1, "user", "lost"), (500, 1, "a", "tie"), (500, 1, "a", "tie"), (500, 1, "b", "tie"), (500, None, None, None)]
    rnd.shuffle(rows)
    return rows


def trie_by_force(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    children, leaves, saved = defaultdict(list), {}, {}
    for k in members:
        if k:
            children[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in children[k])
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in members[k] if len(full[c]) == len(k)).encode()).hexdigest()
    return [(m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(children[k]), leaves[k], saved[k], sha(k)) for k, m in members.items()]


@pytest.mark.parametrize("part_rows", [prefix_trie.PART_ROWS, 50])
def test_prefix_trie(spark, part_rows):
    rows = conversations()
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "k", 1, 2) for r in rows], TURNS).repartition(3), part_rows)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert ordered(map(tuple, got.collect())) == ordered(trie_by_force(rows))


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "k", 1, 2)], TURNS)).count() == 0
    (root,) = prefix_trie.prefix_trie(spark.createDataFrame([(1, 0, "a", "b", "k", 1, 2)], TURNS)).where("depth = 0").collect()
    assert root["n_convs"] == 1


def test_long_ends_stream(spark):
    """Ids beyond one piece give the digest of all of them."""
    ends = spark.range(3000).selectExpr("1L as ka", "2L as kb", "id * 5 as conv")
    (row,) = prefix_trie.digests_of_ends(ends, part_rows=400, chunk=100).collect()
    assert row["ends_sha256"] == hashlib.sha256(",".join(str(i * 5) for i in range(3000)).encode()).hexdigest()


@pytest.mark.parametrize("part_rows", [1 << 20, 7])
def test_running(spark, part_rows):
    rnd = random.Random(2)
    rows = [(min(rnd.randint(0, 9), 4), i, rnd.randint(0, 1 << 61), pa.scalar(1).as_py()) for i in range(500)]
    got = scans.running(spark.createDataFrame(rows, "g int, at int, a long, one long").repartition(5), "g", ["at"], ["a", "one"], part_rows).collect()
    sums, want = defaultdict(lambda: (0, 0)), []
    for g, at, a, one in sorted(rows):
        sums[g] = ((sums[g][0] + a) % (1 << 62), sums[g][1] + one)
        want.append((g, at, *sums[g]))
    assert sorted(map(tuple, got)) == want
