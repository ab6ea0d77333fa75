"""Packing, mixing and truncation."""

import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.llm.mixing import mix, shares
from vellum.llm.packing import containers, fill_report, pack, sum_of_squares
from vellum.llm.tokens import encoding, with_tokens
from vellum.llm.truncation import length_limits, truncated, truncation_rates, with_endings


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sum_of_squares_step_by_step(sizes):
    """Against a plain search over all levels."""
    capacity, level, want = 20, defaultdict(int), []
    for s in sizes:

        def cost(h, s=s):
            after = dict(level)
            if h:
                after[h] -= 1
            if h + s < capacity:
                after[h + s] = after.get(h + s, 0) + 1
            return sum(v * v for v in after.values())

        h = min([*[h for h in range(1, capacity - s + 1) if level[h]], 0], key=lambda h: (cost(h), -h))
        want.append(h)
        if h:
            level[h] -= 1
        if h + s < capacity:
            level[h + s] += 1
    got = sum_of_squares(np.array(sizes, "i8"), capacity)
    fill, seen = defaultdict(int), []
    for s, c in zip(sizes, got.tolist()):
        seen.append(fill[c])
        fill[c] += s
    assert seen == want and all(v <= capacity for v in fill.values())


def test_pack(spark):
    rnd = random.Random(1)
    data = [(i, rnd.choice([rnd.randint(1, 300), rnd.randint(1, 2048), 2048, 5000]), "x") for i in range(3000)] + [(9001, None, "x"), (9002, 0, "x"), (9003, -4, "x"), (None, 5, "x"), (9004, 4096, "x")]
    df = spark.createDataFrame(data, "item long, n long, g string")
    placed = pack(df, "item", "n", block=800).cache()
    held = {r.item_id: 0 for r in placed.collect()}
    pieces = defaultdict(list)
    for r in placed.collect():
        held[r.item_id] += r.tokens
        pieces[r.item_id].append(r)
    assert held == {i: n for i, n, _ in data if i is not None and n and n > 0}
    for i, ps in pieces.items():
        assert len(ps) == max(1, -(-held[i] // 2048))  # whole unless longer
        assert sorted(p.first_token for p in ps) == [2048 * k for k in range(len(ps))]
    c = containers(placed).collect()
    assert all(0 < r.used <= 2048 and r.used + r.unused == 2048 for r in c)
    report = fill_report(placed).first()
    assert report.containers == len(c) and report.unused_share < 0.05 and report.tokens == sum(held.values())
    assert rows(placed) == rows(pack(df.repartition(7), "item", "n", block=800))  # however rows arrive
    none = pack(df.where("1 = 0"), "item", "n")
    assert none.count() == 0 and fill_report(none).first().containers == 0


def mixed(spark, sizes, targets, **kw):
    s = spark.createDataFrame(sizes, "item_id long, source string, tokens long")
    t = spark.createDataFrame(targets, "source_name string, target_share double, max_repeat int")
    chosen = mix(s, t, **kw)
    return chosen.collect(), {r.source_name: r for r in shares(chosen, s, t).collect()}


def test_mix_meets_shares(spark):
    rnd = random.Random(2)
    sizes = [(i, "big" if i % 3 else "small", rnd.randint(1, 20)) for i in range(3000)]
    chosen, report = mixed(spark, [*sizes, (9000, None, 5), (9001, "other", 5), (9002, "big", 0), (9003, "big", None), (None, "big", 4)], [("big", 0.3, 1), ("small", 0.5, 3), ("none", 0.2, 4), (None, 0.1, 1), ("nan", float("nan"), 1), ("small", None, 9)], block=200)
    assert abs(report["big"].actual_share - 0.375) < 0.01 and abs(report["small"].actual_share - 0.625) < 0.01
    assert report["none"].actual_share == 0 and set(report) == {"big", "small", "none"}
    copies = defaultdict(list)
    for r in chosen:
        copies[r.source, r.item_id].append(r.copy)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())
    assert max(len(c) for (s, _), c in copies.items() if s == "small") <= 3 and max(len(c) for (s, _), c in copies.items() if s == "big") == 1


def test_mix_against_a_sorted_queue(spark):
    rnd = random.Random(5)
    sizes = [(i, rnd.choice("abc"), rnd.randint(1, 30)) for i in range(500)]
    chosen, _ = mixed(spark, sizes, [("a", 0.5, 2), ("b", 0.25, 1), ("c", 0.25, 3)], budget=5000, block=50)
    every, _ = mixed(spark, sizes, [("a", 0.5, 2), ("b", 0.25, 1), ("c", 0.25, 3)], budget=10**9, block=50)
    assert len(every) == sum({"a": 2, "b": 1, "c": 3}[s] for _, s, _ in sizes)
    upto, want = 0, set()
    for r in sorted(every, key=lambda r: (r.finish, r.source, r.item_id, r.copy)):
        upto += r.tokens
        if upto > 5000:
            break
        want.add((r.item_id, r.copy))
    assert {(r.item_id, r.copy) for r in chosen} == want
    # finish times are the source's tokens so far over its weight
    a = sorted((r.finish, r.tokens) for r in every if r.source == "a")
    assert np.allclose([f for f, _ in a], np.cumsum([t for _, t in a]) / 0.5)


def test_mix_of_nothing(spark):
    for sizes, targets in (([], [("a", 1.0, 1)]), ([(1, "a", 5)], []), ([(1, "b", 5)], [("a", 1.0, 1)])):
        chosen, _ = mixed(spark, sizes, targets)
        assert chosen == []


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world <|endoftext|>"), (2, None), (3, ""), (4, "word " * 50_000)], "id int, text string")
    got = {r.id: r.tokens for r in with_tokens(df, [F.col("id")], F.col("text")).collect()}
    e = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert got == {1: len(e.encode_ordinary("Hello world <|endoftext|>")), 2: 0, 3: 0, 4: got[4]} and got[4] > 40_000
    assert e.decode(e.encode_ordinary("Zellschicht, é 漢")) == "Zellschicht, é 漢"


ENDINGS = {
    "The wave moves. It then sto": "unfinished",
    "The wave moves. As shown in Fig.": "unfinished",
    "The wave moves along…": "unfinished",
    "The wave moves along [...]": "unfinished",
    "The wave moves. It stops...": "unfinished",
    "The wave moves. It stops;": "unfinished",
    'He said "it stops."': None,
    "It stops (about 2.1 of it). \xa0\n": None,
    "The wave moves.\n- one\n- two": "whole",
    "The wave moves.\nKeywords: one; two": "whole",
    "The wave moves.\nShelfmark LIB-1/2": "whole",
    "The wave moves.\nWave\t0.1\t0.2": "whole",
    "Bare title of a text": "whole",
    "It grew by a factor of 4.": "doubtful",
    "La onda pasa. Después de la onda, ¿qué": "unfinished",
}


def test_endings(spark):
    df = spark.createDataFrame([(t,) for t in ENDINGS], "t string")
    for r in with_endings(df, "t").collect():
        want = ENDINGS[r.t]
        assert (r.unfinished, r.whole) == (want == "unfinished", want == "whole"), r.t
        assert want != "doubtful" or r.doubtful


def test_limits_and_truncation(spark):
    rnd = random.Random(3)

    def prose(n):
        return "".join(f"Die Färbung {'x' * rnd.randint(1, 60)} & ihr \"Größe\" {rnd.randint(0, 99)} wächst.\n" for i in range(n))

    data = []
    for i in range(400):
        t = prose(rnd.randint(4, 40))
        if i % 4 == 0:  # cut at 900 bytes
            t = t.encode()[:900].decode(errors="ignore")
        data.append((i, "bytes", t))
    for i in range(400, 800):
        t = prose(rnd.randint(4, 40))
        escaped = t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        if i % 4 == 0:
            while len(escaped) > 700:
                t = t[:-1]
                escaped = t.replace("&", "&amp;")
        data.append((i, "xml", t))
    data += [(900, None, None), (901, None, " "), (902, None, "Cut he"), (903, None, "Whole. Cut of the mid"), (None, "bytes", "x. y")]
    df = spark.createDataFrame(data, "id int, s string, t string")
    limits = length_limits(df, F.col("s"), F.col("t")).orderBy(F.desc("texts")).collect()
    top = {}
    for r in limits:
        top.setdefault(r.source, (r.measure, r.limit))
    assert top["bytes"][0].startswith("utf8") and top["bytes"][1] == 900 and top["xml"] == ("chars_xml_text", 700)
    judged = truncated(df, F.col("id"), F.col("s"), F.col("t"))
    got = {r.item_id for r in judged.where("truncated and item_id is not null").collect()}
    want = {i for i, _, t in data if i is not None and t and t.strip() and not t.rstrip().endswith(".")} - {902}
    assert got == want
    rate = {r.source: (r.texts, r.truncated) for r in truncation_rates(judged).collect()}
    assert rate[None] == (4, 1) and rate["bytes"][0] == 401
    assert truncated(df.where("1 = 0"), F.col("id"), F.col("s"), F.col("t")).count() == 0
