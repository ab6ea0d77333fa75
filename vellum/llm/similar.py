"""The k most similar vectors of every vector.

A forest of random-projection trees is fitted on a bounded sample; every vector
is put into leaves found by one priority queue over all trees, and the vectors
that meet in a leaf are ranked by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.plans.shared import written

#: Vectors that the trees' thresholds are fitted on, at most. All vectors are indexed.
FIT_ROWS = 20_000


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id, v``: vectors as ``dim`` float32 of unit length, in bytes.

    Null, other lengths, non-finite or null components and zero vectors are
    left out, as are rows without id.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
            with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                # first by the greatest component, so that no square over- or underflows
                top = np.abs(x).max(axis=1)
                x = x / top[:, None]
                norm = np.sqrt((x * x).sum(axis=1))
                ok = np.isfinite(norm) & np.isfinite(top) & (top > 0)
                u = (x[ok] / norm[ok, None]).astype("<f4")
            ids = b.column(0).filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([ids, _binary(u)], names=["id", "v"])

    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).alias("v"))
    return src.where(F.col("id").isNotNull() & (F.size("v") == dim)).mapInArrow(convert, "id string, v binary")


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a contiguous matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype="i4") * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, dim)


class Forest:
    """Trees with one random direction a level and a median threshold a node.

    Thresholds are kept for as many levels as the sample can tell apart, so the size is bounded by the
    sample, not by the data; below them, nodes part at zero.
    """

    def __init__(self, sample: np.ndarray, n: int, trees: int, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = max(0, round(np.log2(max(1, n) / leaf)))
        kept = min(self.depth, max(1, len(sample)).bit_length())
        self.directions, self.thresholds = [], []
        for _ in range(trees):
            d = rng.normal(size=(sample.shape[1], self.depth)).astype("f4")
            p, thr = sample @ d[:, :kept], np.zeros(1 << kept, "f4")
            node = np.ones(len(sample), "i8")
            for level in range(kept):
                order = np.lexsort((p[:, level], node))
                ends = np.searchsorted(node[order], np.arange(1 << level, (2 << level) + 1))
                size = np.diff(ends)
                mid = np.clip((ends[:-1] + ends[1:]) // 2, 0, len(sample) - 1)
                thr[1 << level : 2 << level] = np.where(size > 0, p[order[mid], level], 0)
                node = 2 * node + (p[:, level] >= thr[node])
            self.directions.append(d)
            self.thresholds.append(thr)

    def leaves(self, x: np.ndarray, probes: int) -> np.ndarray:
        """For each row the ``probes`` most promising leaves of all trees.

        One queue a row holds the branches not taken, by the least margin on
        the way to them; the row's own leaf of each tree comes first.
        """
        trees, depth, n = len(self.directions), self.depth, len(x)
        if not depth:
            return np.arange(trees, dtype="i8")[None, :1].repeat(n, 0)
        p = np.stack([x @ d for d in self.directions])
        thr = np.stack(self.thresholds)
        r = np.arange(n)
        room = trees + probes * depth
        margin = np.full((n, room), -np.inf, "f4")
        tree, node, level = np.zeros((n, room), "i2"), np.zeros((n, room), "i8"), np.zeros((n, room), "i1")
        margin[:, :trees], tree[:, :trees], node[:, :trees] = np.inf, np.arange(trees), 1
        used, out = trees, np.empty((n, probes), "i8")
        for i in range(probes):
            j = margin[:, :used].argmax(axis=1)
            best, t, at, start = margin[r, j].copy(), tree[r, j].astype("i8"), node[r, j].astype("i8"), level[r, j]
            margin[r, j] = -np.inf
            for k in range(depth):
                on = start <= k
                m = p[t, r, k] - np.where(at < thr.shape[1], thr[t, np.minimum(at, thr.shape[1] - 1)], 0)
                right = m >= 0
                margin[:, used] = np.where(on, np.minimum(best, -np.abs(m)), -np.inf)
                tree[:, used], node[:, used], level[:, used] = t, 2 * at + ~right, k + 1
                used += 1
                at = np.where(on, 2 * at + right, at)
            out[:, i] = t * (2 << depth) + at
        return out


def _in_leaves(dim: int, k: int, block: int):
    """Rank those that meet in a leaf; input sorted by leaf, output k a row and leaf."""

    def rank(c: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        c, first = np.unique(c, return_index=True)
        x = x[first]
        n, kk = len(c), min(k, len(c) - 1)
        if kk < 1:
            return
        step = max(1, min(block, (1 << 24) // n))  # 64 MB of similarities at a time
        for lo in range(0, n, step):
            s = x[lo : lo + step] @ x.T
            q = np.arange(len(s))
            s[q, lo + q] = -np.inf
            top = np.argpartition(s, n - kk, axis=1)[:, n - kk :] if kk < n else s.argsort(axis=1)
            cos = np.take_along_axis(s, top, axis=1)
            ends = pa.array(np.arange(len(s) + 1, dtype="i4") * kk)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[lo : lo + len(s)]), pa.ListArray.from_arrays(ends, pa.array(c[top].ravel())), pa.ListArray.from_arrays(ends, pa.array(cos.ravel()))],
                names=["c", "near", "cos"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, c, x = np.empty(0, "i8"), np.empty(0, "i8"), np.empty((0, dim), "f4")
        for b in batches:
            leaf = np.concatenate([leaf, b.column(0).to_numpy()])
            c = np.concatenate([c, b.column(1).to_numpy()])
            x = np.concatenate([x, _matrix(b.column(2), dim)])
            cuts = np.flatnonzero(leaf[1:] != leaf[:-1]) + 1
            for lo, hi in zip(np.r_[0, cuts[:-1]], cuts):
                yield from rank(c[lo:hi], x[lo:hi])
            if len(cuts):  # the last leaf may go on in the next batch
                leaf, c, x = leaf[cuts[-1] :], c[cuts[-1] :], x[cuts[-1] :]
        if len(leaf):
            yield from rank(c, x)

    return run


def nearest(classes: DataFrame, dim: int, k: int, trees: int, leaf: int, probes: int, fit_rows: int, seed: int, block: int = 1024) -> DataFrame:
    """``c, near, cos``: of each distinct vector (``c, v``) up to k nearest others.

    ``classes`` must give the same rows each time it is read.
    """
    spark = classes.sparkSession
    n = classes.count()
    # bounded: fit_rows vectors, of about a tenth more that are chosen by hash
    share = int(min(1.0, 1.1 * fit_rows / max(n, 1)) * (1 << 31))
    sample = classes.where(F.pmod(F.xxhash64("c"), F.lit(1 << 31)) < share).limit(fit_rows).select("v").toArrow().column(0).combine_chunks()
    x = _matrix(sample, dim) if n else np.empty((0, dim), "f4")
    forest = Forest(x, n, trees, leaf, seed)
    shared = spark.sparkContext.broadcast(forest)  # no larger than trees times (directions + the sample)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, v = b.column(0), b.column(1)
            found = shared.value.leaves(_matrix(v, dim), probes)
            for j in range(found.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, j]), ids, v], names=["leaf", "c", "v"])

    met = (
        classes.select("c", "v")
        .mapInArrow(probe, "leaf long, c long, v binary")
        .repartition("leaf")
        .sortWithinPartitions("leaf")
        .mapInArrow(_in_leaves(dim, k, block), "c long, near array<long>, cos array<float>")
    )
    # at most `probes` rows a class meet here; rounding differs between leaves, so repeats go by id
    pair = F.flatten(F.collect_list(F.transform(F.arrays_zip("near", "cos"), lambda s: F.struct(s["near"].alias("near"), s["cos"].alias("cos")))))
    ranked = F.array_sort(F.array_distinct("p"), lambda a, b: F.when(a["cos"] > b["cos"], -1).when(a["cos"] < b["cos"], 1).when(a["near"] < b["near"], -1).when(a["near"] > b["near"], 1).otherwise(0))
    return (
        met.groupBy("c")
        .agg(pair.alias("p"))
        .select("c", ranked.alias("p"))
        .withColumn("ids", F.slice(F.array_distinct(F.col("p.near")), 1, k))
        .select("c", F.transform("ids", lambda i: F.struct(i.alias("near"), F.element_at(F.col("p.cos"), F.array_position("p.near", i).cast("int")).alias("cos"))).alias("near"))
    )


def similar_pairs(
    df: DataFrame, id_col: str, vec_col: str, *, dim: int = 64, k: int = 5, trees: int = 3, leaf: int = 128, probes: int = 8, fit_rows: int = FIT_ROWS, seed: int = 7
) -> DataFrame:
    """``id_a < id_b, cosine``: pairs where one is among the k most similar others of the other.

    Only vectors of exactly ``dim`` finite components, not all zero, take
    part. Repeated rows of an id with the same vector count once. Equal vectors are collapsed before
    the search and have cosine 1 with each other; ties go to the smaller id,
    and of more than k + 1 equal vectors each is paired with the next k of its
    copies in id order, within random blocks where copies are very many.
    Cosines are rounded to 6 places. An empty input gives no rows.
    """
    keyed = unit_vectors(df, id_col, vec_col, dim).withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    # the vectors themselves are read again below rather than kept twice
    ids = written(keyed.select("h1", "h2", "id").distinct(), "vector-ids")
    w = Window.partitionBy("h1", "h2").orderBy("id")
    first = ids.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("members"))
    vector = keyed.groupBy("h1", "h2").agg(F.first("v").alias("v"))
    classes = written(vector.join(first, ["h1", "h2"]).select(F.monotonically_increasing_id().alias("c"), "h1", "h2", "members", "v"), "vector-classes")
    member = classes.select("c", "members")

    near = nearest(classes.select("c", "v"), dim, k, trees, leaf, probes, fit_rows, seed)
    others = (
        near.select("c", F.explode("near").alias("s"))
        .select("c", F.col("s.near").alias("o"), F.col("s.cos").alias("cosine"))
        .join(member.select(F.col("c").alias("o"), F.col("members").alias("theirs")), "o")
        .groupBy("c")
        # at most k classes of k + 1 members
        .agg(F.flatten(F.collect_list(F.transform("theirs", lambda m: F.struct((-F.col("cosine")).alias("minus"), m.alias("id"))))).alias("near"))
        .join(member, "c")
    )
    wanted = F.greatest(F.lit(k + 1) - F.size("members"), F.lit(0))
    across = (
        others.select(F.explode("members").alias("a"), F.slice(F.array_sort("near"), F.lit(1), wanted).alias("near"))
        .select("a", F.explode("near").alias("s"))
        .select("a", F.col("s.id").alias("b"), (-F.col("s.minus")).alias("cosine"))
    )
    small = member.where(F.size("members") > 1).select(F.explode("members").alias("a"), "members").select("a", F.explode("members").alias("b")).where("a < b")

    # copies beyond k + 1: next k in id order within blocks of about a thousand
    many = classes.where(F.size("members") > k).select("h1", "h2")
    hot = ids.join(many, ["h1", "h2"], "left_semi")
    sizes = hot.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    block = hot.join(sizes, ["h1", "h2"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.greatest(F.floor(F.col("n") / 1000), F.lit(1))))
    v = Window.partitionBy("h1", "h2", "salt")
    placed = block.withColumns({"i": F.row_number().over(v.orderBy("id")) - 1, "m": F.count("*").over(v)}).select("h1", "h2", "salt", "i", "m", "id")
    step = placed.select("h1", "h2", "salt", F.col("id").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda s: F.pmod(F.col("i") + s, F.col("m")))).alias("i"))
    ring = step.join(placed.select("h1", "h2", "salt", "i", F.col("id").alias("b")), ["h1", "h2", "salt", "i"]).where("a <> b").select("a", "b")

    pairs = across.unionByName(small.unionByName(ring).withColumn("cosine", F.lit(1.0).cast("float")))
    return pairs.groupBy(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).agg(F.round(F.max(F.col("cosine").cast("double")), 6).alias("cosine"))
