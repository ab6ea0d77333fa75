"""Vectors as arrays, and exact nearest neighbours by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """[VEC8] Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """[VEC1] A vector of unit length; a vector of no length raises, null stays null."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, F.raise_error(F.lit("a vector of no length can't be normalised"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def query_vector(values) -> list[float]:
    """[VEC2] A query vector as floats; anything but a flat sequence of numbers is a TypeError."""
    if isinstance(values, (str, bytes, dict)) or not hasattr(values, "__iter__"):
        raise TypeError("a query vector is a sequence of numbers")
    flat = np.asarray(values if isinstance(values, np.ndarray) else list(values))
    if flat.ndim != 1 or flat.dtype.kind not in "iuf" or not flat.size:
        raise TypeError("a query vector is a flat sequence of numbers")
    return [float(x) for x in flat]


def dimensions(df: DataFrame, vector: str) -> DataFrame:
    """[VEC7] How many vectors of each dimension; null vectors count as -1."""
    return df.groupBy(F.coalesce(F.size(vector), F.lit(-1)).alias("dimension")).agg(F.count("*").alias("n"))


def pooled(df: DataFrame, key: str, vector: str, weight: Column) -> DataFrame:
    """[AGG7] ``key, pooled``: weighted mean of each key's vectors, brought to unit length.

    Weights of zero or less, null vectors and null weights are left out; keys left without a vector don't come
    out. Components are summed apart, with partial sums before the shuffle.
    """
    flat = df.select(F.col(key), weight.cast("double").alias("w"), F.posexplode(vector).alias("i", "x")).where("w > 0")
    mean = flat.groupBy(key, "i").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("x"))
    whole = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    return whole.where(norm > 0).select(key, F.transform("v", lambda x: x / norm).alias("pooled"))


def nearest_neighbours(rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, vector: str, k: int, *, dim: int, exclude_self: bool = False, row_block: int = 8192, query_block: int = 512) -> DataFrame:
    """[RET1] ``query_id, row_id, distance, rank``: the k rows nearest to each query by squared Euclidean distance, exactly.

    Queries and rows are gathered in blocks of bounded size; each block of queries meets each
    block of rows once, through a key, and only the k best of each meeting go on. Vectors of another
    dimension, or with null or non-finite components, are left out; ties go to the smaller id. Fewer than k
    rows give as many as there are.
    """
    if k <= 0:
        raise ValueError("k must be positive")

    def usable(df: DataFrame, id_col: str, name: str) -> DataFrame:
        fine = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias(name), F.col(vector).alias("v"))

    r, q = usable(rows, row_id, "row_id"), usable(queries, query_id, "query_id")
    n_r, n_q = (max(1, -(-df.count() // b)) for df, b in ((r, row_block), (q, query_block)))
    rb = r.groupBy(F.pmod(F.xxhash64("row_id"), F.lit(n_r)).alias("rb")).agg(F.collect_list(F.struct("row_id", "v")).alias("rows"))
    qb = q.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("qb")).agg(F.collect_list(F.struct("query_id", "v")).alias("queries"))
    met = qb.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1)))).withColumn("rb", F.col("rb").cast("long")).join(rb, "rb")
    q_kind, r_kind = q.schema["query_id"].dataType.simpleString(), r.schema["row_id"].dataType.simpleString()

    def matrix(structs: pa.StructArray) -> np.ndarray:
        v = structs.field("v")
        return v.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(structs), dim)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                left, right = b.column("queries")[i].values, b.column("rows")[i].values
                x, y = matrix(left), matrix(right)
                ids = right.field("row_id").to_pylist()
                q_ids = left.field("query_id").to_pylist()
                d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
                kk = min(k + exclude_self, len(ids))
                # all that tie with the last are kept until the ids decide
                bound = np.partition(d, kk - 1, axis=1)[:, kk - 1 : kk] + 1e-9
                at, j = np.nonzero(d <= bound)
                exact = ((x[at] - y[j]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array([q_ids[a] for a in at], left.field("query_id").type), "row_id": pa.array([ids[c] for c in j], right.field("row_id").type), "distance": exact})

    found = met.mapInArrow(best, f"query_id {q_kind}, row_id {r_kind}, distance double").withColumn("distance", F.round("distance", 9))
    if exclude_self:
        found = found.where("query_id <> row_id")
    w = Window.partitionBy("query_id").orderBy("distance", "row_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
