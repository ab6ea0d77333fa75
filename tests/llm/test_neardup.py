import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm.neardup import Pivots, _large, group_pairs, limit, near_duplicates
from vellum.llm.words import WordHashes, shingles, words

SCHEMA = "kind string, id string, text string, fp string"


def brute(data, size, threshold, min_words):
    sets = {}
    for kind, i, text, _ in data:
        ws = words(text) if text and i and kind else []
        if len(ws) >= max(min_words, size):
            sets[kind, i] = {tuple(ws[j : j + size]) for j in range(len(ws) - size + 1)}
    parent = {k: k for k in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if a[0] == b[0] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12:
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in keys:
        groups[find(k)].append(k)
    return {(a[0], a[1], b[1]) for g in groups.values() for a in g for b in g if a[1] < b[1]}


def made(n, seed, edits=3):
    rnd = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(300)]
    data = []
    for f in range(n):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(40, 120))]
        for c in range(rnd.choice([1, 1, 2, 4])):
            ws = list(base)
            for _ in range(rnd.randint(0, edits)):
                p = rnd.randrange(len(ws))
                rnd.choice([lambda: ws.insert(p, "new"), lambda: ws.pop(p), lambda: ws.__setitem__(p, "other")])()
            data.append((rnd.choice(["chunk", "evidence"]), f"{f}-{c}", " ".join(ws).capitalize() + ".", ""))
    return data


@pytest.mark.parametrize("small", [64, 3])
def test_against_brute_force(spark, small):
    data = made(60, 1) + [("chunk", "nul", None, ""), ("chunk", "emp", "", ""), ("chunk", None, "x " * 50, ""), (None, "k", "y " * 50, ""), ("chunk", "few", "a b c", "")]
    data += data[:5]  # repeated rows
    df = spark.createDataFrame(data, SCHEMA)
    groups = near_duplicates(df, F.col("kind"), F.col("id"), F.col("text"), size=3, threshold=0.6, min_words=40, bands=36, rows=4, small=small)
    got = [tuple(r) for r in group_pairs(groups).collect()]
    want = brute(data, 3, 0.6, 40)
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.98 * len(want)
    ids = [tuple(r) for r in groups.select("kind", "id").collect()]
    assert len(ids) == len(set(ids)) and not {"nul", "emp", "few"} & {i for _, i in ids}


def test_a_third_of_one_family(spark):
    """Large buckets: a hot family that closes only through chains, and many exact copies."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    chain = []
    for i in range(120):  # each differs a little from the one before
        base = list(base)
        base[rnd.randrange(60)] = f"n{i}"
        chain.append(("chunk", f"c{i:03d}", " ".join(base), ""))
    copies = [("chunk", f"x{i:03d}", " ".join(f"v{j}" for j in range(50)), "") for i in range(200)]
    data = chain + copies + made(20, 5)
    df = spark.createDataFrame(data, SCHEMA)
    g = near_duplicates(df, F.col("kind"), F.col("id"), F.col("text"), size=3, threshold=0.6, min_words=40, bands=36, rows=4, small=4).collect()
    of = {r.id: r.group_id for r in g if r.kind == "chunk"}
    assert len({of[f"c{i:03d}"] for i in range(120)}) == 1 and len({of[f"x{i:03d}"] for i in range(200)}) == 1
    assert {r.links for r in g if r.id.startswith("x")} == {0}  # one text


def test_links_of_a_large_family(spark):
    """Links are counted against brute force, also inside groups that meet in large buckets only."""
    rnd, data = random.Random(8), []
    for f, n in (("p", 90), ("q", 70)):
        base = [f"{f}{i}" for i in range(80)]
        for c in range(n):
            ws = list(base)
            for p in rnd.sample(range(80), rnd.randint(1, 2)):
                ws[p] = f"new{c}"
            data.append(("chunk", f"{f}{c:03d}", " ".join(ws), ""))
    sets = {i: {tuple(ws[j : j + 3]) for j in range(len(ws) - 2)} for _, i, text, _ in data for ws in [words(text)]}
    want = {a: sum(a != b and len(x & y) >= 0.6 * len(x | y) for b, y in sets.items()) for a, x in sets.items()}
    df = spark.createDataFrame(data, SCHEMA)
    for small in (64, 3):
        keys = {"size": 3, "threshold": 0.6, "min_words": 40, "bands": 36, "rows": 4, "small": small}
        got = near_duplicates(df, F.col("kind"), F.col("id"), F.col("text"), **keys).collect()
        assert {r.id: r.links for r in got} == want and len(got) == len(data)
        bare = near_duplicates(df, F.col("kind"), F.col("id"), F.col("text"), count_links=False, **keys)
        assert bare.columns == ["kind", "id", "group_id"] and {tuple(r) for r in bare.collect()} == {(r.kind, r.id, r.group_id) for r in got}


@pytest.mark.parametrize("block", [4, 2048])
def test_pairs_of_large_buckets_in_blocks(spark, block):
    """All pairs of the buckets that pass, each once; with groups only those across them."""
    buckets = {1: range(30), 2: range(20, 45), 3: [3, 50]}
    name = lambda i: bytes([i] * 16)
    stars = [(name(m[0]), name(b), big) for big, m in buckets.items() for b in m[1:]] + [(name(7), name(60), None)]
    far = {25}  # by its size near to none, by its distances too
    records = [(name(i), 1000 if i in far else 100, bytes([100 if i in far else 0] * 32)) for i in range(61)]
    df = spark.createDataFrame(stars, "a binary, b binary, big long")
    s = spark.createDataFrame(records, "fp binary, n int, pivots binary")
    all_pairs = {(a, b) for m in buckets.values() for a in m for b in m if a < b and not {a, b} & far}
    got = [(r.a[0], r.b[0]) for r in _large(df, s, None, 0.6, 4.5, block).collect()]
    assert sorted(got) == sorted(all_pairs)
    component = {i: 0 if i < 15 else 20 if i < 24 else i for i in range(61)}
    g = spark.createDataFrame([(name(i), name(c)) for i, c in component.items() if c != i or i in (0, 20)], "node binary, component binary")
    got = [(r.a[0], r.b[0]) for r in _large(df, s, g, 0.6, 4.5, block).collect()]
    assert sorted(got) == sorted(p for p in all_pairs if component[p[0]] != component[p[1]])


def test_three_hundred_variants(spark):
    """All links of a large family, whatever the size of a bucket that is done at once; copies don't add to them."""
    base = [f"w{i}" for i in range(60)]
    data = [("chunk", f"v{i:03d}", " ".join([*base, f"end{i}"]), "") for i in range(300)]
    df = spark.createDataFrame(data + [("chunk", f"copy{i}", data[0][2], "") for i in range(50)], SCHEMA)
    for small in (1000, 64):
        got = near_duplicates(df, F.col("kind"), F.col("id"), F.col("text"), size=3, threshold=0.6, min_words=40, bands=36, rows=4, small=small).collect()
        assert len(got) == 350 and {r.links for r in got} == {299} and {r.group_id for r in got} == {"copy0"}


def test_defaults_and_empty(spark):
    df = spark.createDataFrame(made(10, 9, 0), SCHEMA)
    got = near_duplicates(df, F.col("kind"), F.col("id"), F.col("text"))
    assert {tuple(r) for r in group_pairs(got).collect()} == brute([tuple(r) for r in df.collect()], 5, 0.8, 0)
    none = near_duplicates(df.where("1 = 0"), F.col("kind"), F.col("id"), F.col("text"))
    assert none.count() == 0 and group_pairs(none).count() == 0


def test_pivots_keep_near_pairs_and_drop_far_ones():
    rnd, p, h = random.Random(2), Pivots(256), WordHashes()
    near = far = near_kept = far_kept = 0
    for _ in range(300):
        a = [str(rnd.randrange(10**6)) for _ in range(100)]
        b = list(a)
        for _ in range(6):
            b[rnd.randrange(100)] = "x" + str(rnd.randrange(99))
        c = [str(rnd.randrange(10**6)) for _ in range(100)]
        x, y, z = (shingles(w, 3, h) for w in (a, b, c))
        for other, same in ((y, True), (z, False)):
            gap = np.abs(p.table(x).astype(int) - p.table(other)).max()
            ok = gap <= limit(np.array(len(x) + len(other)), 0.6, 4.5)
            near, near_kept = near + same, near_kept + (same and ok)
            far, far_kept = far + (not same), far_kept + (not same and ok)
    assert near_kept == near and far_kept < 0.03 * far


def test_table_is_a_hamming_distance():
    p, h = Pivots(8, 256), shingles("a b c d e f g".split(), 3, WordHashes())
    bits = np.zeros(256, int)
    bits[np.unique(h & np.uint64(255)).astype(int)] = 1
    for j in range(8):
        reference = (p.sign[:, j] < 0).astype(int)
        d = (bits != reference).sum() - reference.sum()
        assert d == p.distances(h)[j] and d >> 1 == p.table(h)[j]
