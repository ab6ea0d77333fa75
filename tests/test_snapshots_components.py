import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.functions.paths import hash_set, path_key
from vellum.operators.components import connected_components
from vellum.operators.snapshot_diff import delivered_versions, snapshot_changes

STATE = "no int, path string, hashes array<string>, at int, extra string"


def changes(spark, data):
    df = spark.createDataFrame(data, STATE)
    v = delivered_versions(df, "no", path_key(F.col("path")), [F.col("at")], {"hashes": hash_set(F.col("hashes"))})
    return rows(snapshot_changes(v, df.select(F.col("no").alias("snapshot")).where("snapshot is not null")))


def test_changes(spark):
    data = [
        (1, "A\\b", ["x"], 1, ""),
        (1, "keep", ["Y", "z"], 1, ""),
        (1, "gone", None, 1, ""),
        (1, None, ["q"], 1, ""),
        (4, "a/B", ["X", "x"], 1, ""),  # the same set
        (4, "keep", ["z"], 1, ""),
        (4, "keep", ["z", "y", None], 9, ""),  # delivered last
        (4, "keep", ["z", "y", None], 9, ""),
        (4, "new", [], None, ""),
        (6, None, None, 1, ""),  # delivered without a usable row
        (9, "new", None, 1, ""),
        (None, "lost", None, 1, ""),
    ]
    assert changes(spark, data) == sorted(
        [(4, "gone", "removed"), (4, "new", "added"), (6, "a/b", "removed"), (6, "keep", "removed"), (6, "new", "removed"), (9, "new", "added")], key=repr
    )
    assert changes(spark, []) == []
    assert changes(spark, data[:3]) == []


def test_changes_against_dictionaries(spark):
    rnd = random.Random(2)
    data = [(rnd.choice([1, 2, 5, 7]), f"p{rnd.randint(0, 9)}", rnd.sample(["a", "b", "c"], rnd.randint(0, 2)), rnd.randint(0, 99), "") for _ in range(90)]
    best = {}
    for no, p, h, at, _ in data:
        best[no, p] = max(best.get((no, p), (-1, [])), (at, sorted(h)))
    want, order = [], [1, 2, 5, 7]
    for a, b in zip(order, order[1:]):
        for p in {p for _, p in best}:
            x, y = best.get((a, p)), best.get((b, p))
            if x and not y:
                want.append((b, p, "removed"))
            elif y and not x:
                want.append((b, p, "added"))
            elif x and y and x[1] != y[1]:
                want.append((b, p, "changed"))
    assert changes(spark, data) == sorted(want, key=repr)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (2, 3), (3, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(40)] + [(100, 101)], None])
def test_components(spark, edges):
    if edges is None:
        rnd = random.Random(1)
        edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = connected_components(spark.createDataFrame(edges + [(None, 3)], "a long, b long"))
    assert rows(got) == sorted([(n, find(n)) for n in list(parent)], key=repr)
