import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.operators.evidence import evidence_context, lexical_gate, select_evidence, without_repeats
from vellum.operators.retrieval import bm25, build_index, fuse, refine
from vellum.operators.vectors import l2_normalize, nearest_neighbours, pooled, query_vector


def test_nearest_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).round(1)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 8), (903, [None] * 8), (None, [0.0] * 8)]
    df = spark.createDataFrame(data, "id long, v array<double>")
    got = nearest_neighbours(df, df.where("id % 50 = 0"), "id", "id", "v", 5, dim=8, exclude_self=True, row_block=64, query_block=2)
    want = []
    for q in range(0, 300, 50):
        d = ((x - x[q]) ** 2).sum(axis=1)
        order = sorted((round(float(d[i]), 9), i) for i in range(300) if i != q)[:5]
        want += [(q, i, k + 1) for k, (_, i) in enumerate(order)]
    assert rows(got, "query_id", "row_id", "rank") == sorted(want, key=repr)
    none = df.where("id < 0")
    assert nearest_neighbours(none, none, "id", "id", "v", 5, dim=8).count() == 0
    with pytest.raises(ValueError):
        nearest_neighbours(df, df, "id", "id", "v", 0, dim=8)


def test_vectors(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0], 1.0), ("a", [0.0, 0.0], 5.0), ("b", None, 1.0), ("c", [1.0, 0.0], 0.0), ("d", [0.0, 2.0], None)], "k string, v array<float>, w double")
    assert [(k, [round(x, 12) for x in v]) for k, v in rows(pooled(df, "k", "v", F.col("w")))] == [("a", [0.6, 0.8])]
    assert df.where("k = 'a' and w = 1").select(l2_normalize(F.col("v"))).first()[0] == [0.6, 0.8]
    with pytest.raises(Exception, match="no length"):
        df.where("w = 5").select(l2_normalize(F.col("v"))).collect()
    assert query_vector(np.array([1, 2])) == [1.0, 2.0]
    for bad in ("12", {"a": 1}, [[1.0]], [], None, ["x"]):
        with pytest.raises(TypeError):
            query_vector(bad)


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "cells move tissue"), (2, "tissue tissue shape"), (3, None), (4, ""), (1, "cells move tissue"), (None, "tissue")], "id long, text string")
    index, stats = build_index(docs, "id", F.col("text"))
    q = spark.createDataFrame([(7, "tissue shape?"), (8, "the of"), (9, None), (10, "")], "query_id long, question string")
    got = bm25(index, stats, q, 5).collect()
    assert [(r.query_id, r.id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(7, 2, 1), (7, 1, 2)]
    idf = np.log(1 + (2 - 2 + 0.5) / 2.5)
    assert abs([r.score for r in got if r.id == 1][0] - idf * 2.2 / (1 + 1.2)) < 1e-8


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id long, id string, rank int")
    one, two = rows(fuse([a, b], 3)), rows(fuse([b, a], 3))
    assert one == two and [r[1] for r in sorted(one, key=lambda r: r[3])] == ["y", "x", "z"]


def literal_refine(cands, k, most):
    ranked = sorted(cands, key=lambda c: (-c["refined"], -c["score"], c["rank"]))
    kept, deferred, n = [], [], 0
    for c in ranked:
        if c["cap"]:
            if n >= most:
                deferred.append(c)
                continue
            n += 1
        kept.append(c)
        if len(kept) >= k:
            break
    for c in deferred:
        if len(kept) < k:
            kept.append(c)
    return [c["id"] for c in sorted(kept, key=lambda c: (-c["refined"], -c["score"]))]


def test_refine_against_two_passes(spark):
    rnd = random.Random(4)
    data, want = [], {}
    for q in range(60):
        cands = []
        for r in range(rnd.randint(1, 14)):
            kind = rnd.choice(["caption", "body", "methods", "supplementary"])
            score = rnd.choice([0.03, 0.025, 0.02])
            w = {"caption": 0.8, "methods": 0.97, "supplementary": 0.92}.get(kind, 1.0)
            cands.append({"id": f"i{r:02d}", "score": score, "rank": r + 1, "cap": kind == "caption", "refined": score * w})
            data.append((q, f"i{r:02d}", score, r + 1, kind, None))
        want[q] = literal_refine(cands, 5, 2)
    df = spark.createDataFrame(data, "query_id int, id string, score double, rank int, chunk_type string, section string")
    got = {}
    for r in refine(df, 5).orderBy("query_id", "final_rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want


def test_null_scores_fall_back(spark):
    df = spark.createDataFrame([(1, "a", None, 1, None, None), (1, "b", float("nan"), 2, "", "")], "query_id int, id string, score double, rank int, chunk_type string, section string")
    assert [round(r.base, 6) for r in refine(df, 5).orderBy("final_rank").collect()] == [round(1 / 61, 6), round(1 / 62, 6)]


LONG = "This paragraph is long enough to be told apart from others because it goes on for more than one hundred and twenty characters in all."


def cand(q, rank, cid, text):
    return (q, rank, cid, text, "f.pdf")


def test_evidence(spark):
    schema = "query_id int, rank int, chunk_id string, text string, filename string"
    data = [
        cand(1, 1, "a", LONG + "\n\n" + "short one"),
        cand(1, 2, "b", LONG.upper().replace(" ", "  ") + "\n\n" + "short one " + "word " * 25),
        cand(1, 3, "a", "again"),
        cand(1, 4, "c", "tiny"),
        cand(1, 5, "d", "big " * 200),
        cand(1, 6, "e", "fits " * 20),
        cand(1, 7, None, "x " * 30),
        cand(1, 8, "g", None),
        cand(2, 1, "a", LONG),
    ]
    df = spark.createDataFrame(data, schema)
    kept = {(r.query_id, r.chunk_id): r.text for r in without_repeats(df).collect()}
    assert kept[(1, "b")].startswith("short one word") and (1, "a") in kept and (2, "a") in kept and (1, "g") not in kept
    got = select_evidence(df, 8, 90).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.source_id, r.chunk_id) for r in got] == [(1, "S1", "a"), (1, "S2", "b"), (1, "S3", "e"), (2, "S1", "a")]
    for q in (1, 2):
        assert sum(r.token_count for r in got if r.query_id == q) <= 90
    assert select_evidence(df.where("1 = 0"), 8, 90).count() == 0


def test_evidence_of_any_rank(spark):
    """Candidates beyond rank 36 count when those before them are too short, unless a pool is asked for."""
    df = spark.createDataFrame([cand(1, r, f"c{r:02d}", "tiny" if r < 40 else f"text {r} " + "word " * 30) for r in range(1, 43)], "query_id int, rank int, chunk_id string, text string, filename string")
    assert sorted((r.source_id, r.chunk_id) for r in select_evidence(df, 2, 500).collect()) == [("S1", "c40"), ("S2", "c41")]
    assert select_evidence(df, 2, 500, pool=36).count() == 0


def test_gate(spark):
    q = spark.createDataFrame([(1, "How does tissue shape?"), (2, "What is IL-6 in tissue?"), (3, "Chocolate cake?"), (4, "is it"), (5, "Loss of IL-6 and BRM014?")], "query_id int, question string")
    e = spark.createDataFrame([(1, "The tissue bends."), (2, "tissue only"), (3, "tissue"), (5, "il-6 was lost"), (5, None)], "query_id int, text string")
    assert [(r.query_id, r.sufficient) for r in lexical_gate(q, e).orderBy("query_id").collect()] == [(1, True), (2, False), (3, False), (4, True), (5, True)]


def test_context(spark):
    e = spark.createDataFrame([(1, "S10", "f", 1, 2, "Sec", "body", "T", None, "ten", 3), (1, "S2", "g", 4, 4, None, "body", "", "A", "two", 2)], "query_id int, source_id string, filename string, page_start int, page_end int, section string, chunk_type string, title string, author string, text string, token_count int")
    r = evidence_context(e).first()
    assert r.tokens == 5
    assert r.context == "[S2]\nFile: g\nPage(s): 4\nSection: \nType: body\nAuthor: A\n\ntwo\n\n" + "=" * 72 + "\n\n[S10]\nFile: f\nPage(s): 1-2\nSection: Sec\nType: body\nTitle: T\n\nten"
