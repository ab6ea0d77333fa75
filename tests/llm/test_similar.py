import numpy as np
import pytest

from vellum.llm.similar import Forest, similar_pairs

SCHEMA = "id string, v array<float>, c long"


def brute(x, ids, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    out = set()
    for i, r in enumerate(s):
        for j in np.argsort(-r, kind="stable")[:k]:
            out.add(tuple(sorted((ids[i], ids[j]))))
    return out


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.15 * rng.normal(size=(n, dim))).astype("f4")


@pytest.mark.parametrize("n,leaf", [(1500, 64), (40, 128)])
def test_recall_against_brute_force(spark, n, leaf):
    x = clustered(n, 16)
    ids = [f"i{i:05d}" for i in range(n)]
    # `c` clashes with a column of the operator's own
    df = spark.createDataFrame([(a, v.tolist(), 1) for a, v in zip(ids, x)], SCHEMA)
    got = {(r.id_a, r.id_b) for r in similar_pairs(df, "id", "v", dim=16, leaf=leaf).collect()}
    want = brute(x.astype("f8"), ids, 5)
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_odd_vectors(spark):
    good = [("a", [1.0, 0.0, 0.0, 0.0]), ("b", [1.0, 0.1, 0.0, 0.0]), ("c", [0.0, 0.0, 2.0, 0.0]), ("d", [3e38, 3e37, 0.0, 0.0]), ("e", [1e-40, 0.0, 0.0, 0.0])]
    bad = [("n", None), ("s", [1.0]), ("z", [0.0] * 4), ("x", [float("nan")] * 4), ("y", [float("inf"), 0.0, 0.0, 0.0]), ("w", [None, 1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in [*good, *good, *bad]], SCHEMA)
    got = {(r.id_a, r.id_b): r.cosine for r in similar_pairs(df, "id", "v", dim=4, k=5).collect()}
    assert set(got) == {(a, b) for a in "abcde" for b in "abcde" if a < b}
    assert got[("a", "e")] == 1.0 and got[("b", "d")] == 1.0 and got[("a", "c")] == 0.0
    assert similar_pairs(df.where("id = 'n'"), "id", "v", dim=4).count() == 0
    assert similar_pairs(df.where("1 = 0"), "id", "v", dim=4).count() == 0
    assert similar_pairs(df.where("id = 'a'"), "id", "v", dim=4).count() == 0


@pytest.mark.parametrize("copies", [2, 5, 6, 7, 2500])
def test_copies(spark, copies):
    """Each copy is paired with as many others as it has, up to k; the rest come from elsewhere."""
    x = [(f"h{i:05d}", [1.0, 2.0, 3.0, 4.0], 0) for i in range(copies)] + [(f"o{i}", [1.0, 2.0, 3.0, 4.1 + i], 0) for i in range(8)]
    got = [(r.id_a, r.id_b) for r in similar_pairs(spark.createDataFrame(x, SCHEMA), "id", "v", dim=4, k=5).collect()]
    assert len(set(got)) == len(got)
    near = {}
    for a, b in got:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for i in range(copies):
        mine = near[f"h{i:05d}"]
        assert len(mine) >= 5 and sum(b[0] == "h" for b in mine) >= min(5, copies - 1)


def test_forest_covers_every_vector():
    x = clustered(3000, 16)
    f = Forest(x[:200], len(x), 3, 64, 1)  # fitted on a fifteenth
    found = f.leaves(x, 8)
    assert found.shape == (3000, 8)
    assert all(len(set(r)) == 8 for r in found.tolist())
    assert np.unique(found[:, 0], return_counts=True)[1].max() < 3000 / 4


def test_size_of_the_forest_is_bound_by_the_sample():
    x = clustered(4000, 16)
    small = Forest(x[:50], 10**9, 3, 128, 1)
    assert small.depth == 23 and sum(t.nbytes for t in small.thresholds) <= 3 * 4 * 128
    found = small.leaves(x, 4)
    assert all(len(set(r)) == 4 for r in found.tolist()) and len(np.unique(found[:, 0])) > 1000
