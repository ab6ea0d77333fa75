"""Records that share most of their word runs, grouped.

Bands of a few min-hashes propose pairs, loosely. The table of Hamming distances
from every record's fingerprint to many reference fingerprints (pivots) then
decides which of them are looked at: pairs whose greatest coordinate difference is
too large are discarded. The Jaccard similarity of the survivors is computed
exactly, and verified links are closed to groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.words import WordHashes, mix, shingles, words
from vellum.operators.components import connected_components
from vellum.plans.shared import written

#: Members of a band's bucket up to which its pairs are made in one task; those of larger buckets are met in blocks. The result doesn't depend on it.
SMALL_BUCKET = 64
#: Members of a block of a large bucket, or of a large group, about.
BLOCK = 2048


class Pivots:
    """Hamming distances from a record's fingerprint to ``count`` reference fingerprints.

    A fingerprint has ``bits`` bits, of which each word run sets one. With
    reference P, d(x, P) = |P| + the sum, over the bits that x sets, of +1 where P has 0
    and -1 where it has 1; the constant |P| is left out of the table. Coordinates are kept
    halved, in one byte; those beyond its range are clipped, which makes differences smaller, never larger.
    """

    def __init__(self, count: int, bits: int = 1 << 14, seed: int = 11):
        self.count, self.bits = count, bits
        self.sign = np.random.default_rng(seed).integers(0, 2, (bits, count), dtype="i1") * 2 - 1

    def distances(self, h: np.ndarray) -> np.ndarray:
        """The record's distances, less the constants."""
        return self.sign[np.unique(h & np.uint64(self.bits - 1)).astype("i8")].sum(axis=0, dtype="i4")

    def table(self, h: np.ndarray) -> np.ndarray:
        """The distances as they are kept."""
        return np.clip(self.distances(h) >> 1, -127, 127).astype("i1")


def limit(n: np.ndarray, threshold: float, sigmas: float) -> np.ndarray:
    """Largest difference of halved coordinates of a pair with together ``n`` word runs.

    A pair of Jaccard similarity t differs in at most (1-t)/(1+t) n runs, and so in as many
    bits at most. A reference, drawn at random, moves each by +1 or -1, so that the difference
    has at most the square root of that as its standard deviation.
    """
    # halved coordinates are rounded down: half a unit at most
    return sigmas * np.sqrt(n * (1 - threshold) / (1 + threshold)) / 2 + 0.5


def _prints(column: pa.Array) -> np.ndarray:
    """Fingerprints as an array of 16 bytes each, in the order of their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), "V16").view(">u8").reshape(-1, 2)


def _binary(prints: np.ndarray) -> pa.Array:
    """The reverse of ``_prints``."""
    raw = np.ascontiguousarray(prints, ">u8")
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(len(raw) + 1, dtype="i4") * 16), pa.py_buffer(raw)])


def _records(size: int, min_words: int, pivots: Pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for b in batches:
            kinds, ids, texts = (c.to_pylist() for c in b.columns)
            out: list[tuple] = []
            for kind, i, text in zip(kinds, ids, texts):
                ws = words(text)
                if len(ws) < max(min_words, size):
                    continue
                h = shingles(ws, size, seen)
                raw = h.tobytes()
                out.append((kind, i, xxhash.xxh3_128_digest(raw, xxhash.xxh3_64_intdigest(kind)), len(h), raw, pivots.table(h).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate([pa.string(), pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.binary()])], names=["kind", "id", "fp", "n", "runs", "pivots"])

    return run


def _bands(bands: int, rows: int, seed: int = 5):
    """Rows (band, fp): min-hashes of a record, ``rows`` to a band. Copies of a text within a task are passed over, so that hot ones don't fill a bucket."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 1 << 62, bands * rows, dtype="u8") * np.uint64(2) + np.uint64(1)
    band_mult = rng.integers(1, 1 << 62, rows, dtype="u8") * np.uint64(2) + np.uint64(1)
    mult32 = (mult >> np.uint64(31)).astype("u4") | np.uint32(1)
    add32 = rng.integers(0, 1 << 32, bands * rows, dtype="u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for b in batches:
            if len(done) > 1_000_000:
                done.clear()
            prints, keys = [], []
            for kind, fp, raw in zip(*(c.to_pylist() for c in b.columns)):
                if fp in done:
                    continue
                done.add(fp)
                h = (np.frombuffer(raw, "u8") >> np.uint64(32)).astype("u4")
                # multiply-shift in 32 bits: the high half decides
                low = np.empty(bands * rows, "u4")
                for lo in range(0, len(h), 512):
                    part = (h[lo : lo + 512, None] * mult32 + add32).min(axis=0)
                    low = part if lo == 0 else np.minimum(low, part)
                keys.append((low.reshape(bands, rows).astype("u8") * band_mult).sum(axis=1) + np.uint64(xxhash.xxh3_64_intdigest(kind)))
                prints.append(fp)
            if prints:
                key = mix(np.stack(keys) + np.arange(bands, dtype="u8") * np.uint64(0x632BE59BD9B4E019))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view("i8")), pa.array([p for p in prints for _ in range(bands)], pa.binary())], names=["band", "fp"])

    return run


def _pairs(small: int, hold: int = 1 << 20):
    """Candidates of buckets that come sorted by (band, fp).

    A bucket of more than ``small`` members gives its first member with each other,
    and names the band in ``big``. Of an open bucket no more than ``hold`` members are held.
    """

    def links(band: int, fp: np.ndarray, star: bool, out: list) -> None:
        if len(fp) < 2:
            return
        if star or len(fp) > small:
            out.append((np.repeat(fp[:1], len(fp) - 1, axis=0), fp[1:], np.full(len(fp) - 1, band)))
        else:
            i, j = np.triu_indices(len(fp), 1)
            out.append((fp[i], fp[j], np.zeros(len(i), "i8")))

    def batch_of(out: list) -> pa.RecordBatch:
        a, b = (np.concatenate([o[i] for o in out]) if out else np.empty((0, 2), ">u8") for i in range(2))
        big = np.concatenate([o[2] for o in out]) if out else np.empty(0, "i8")
        return pa.RecordBatch.from_arrays([_binary(a), _binary(b), pa.array(big, mask=big == 0)], names=["a", "b", "big"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, fp, star = np.empty(0, "i8"), np.empty((0, 2), ">u8"), False
        for batch in batches:
            band, fp = np.concatenate([band, batch.column(0).to_numpy()]), np.concatenate([fp, _prints(batch.column(1))])
            if not len(band):
                continue
            new = np.r_[True, (band[1:] != band[:-1]) | (fp[1:] != fp[:-1]).any(axis=1)]
            band, fp = band[new], fp[new]
            edge = np.r_[0, np.flatnonzero(band[1:] != band[:-1]) + 1, len(band)]
            out: list = []
            for g in np.flatnonzero(np.diff(edge[:-1]) > 1):
                links(band[edge[g]], fp[edge[g] : edge[g + 1]], star and g == 0, out)
            star = star and len(edge) == 2
            band, fp = band[edge[-2] :], fp[edge[-2] :]  # the last bucket may go on
            if len(fp) > hold:
                links(band[0], fp, True, out)
                band, fp, star = band[:1], fp[:1], True
            yield batch_of(out)
        if len(fp) > 1:
            out = []
            links(band[0], fp, star, out)
            yield batch_of(out)

    return run


def _near(sigmas: float, threshold: float):
    """Drop pairs whose sizes, or whose distances to some pivot, differ too much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = b.column("na").to_numpy().astype("f8"), b.column("nb").to_numpy().astype("f8")
            pa_, pb = (np.frombuffer(b"".join(b.column(c).to_pylist()), "i1").reshape(b.num_rows, -1).astype("i2") for c in ("pa", "pb"))
            far = np.abs(pa_ - pb).max(axis=1)
            keep = (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9) & (far <= limit(na + nb, threshold, sigmas))
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verify(threshold: float):
    """Exact Jaccard similarity of the word runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = np.empty(b.num_rows)
            for i, (x, y) in enumerate(zip(b.column("ra").to_pylist(), b.column("rb").to_pylist())):
                x, y = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                sim[i] = common / (len(both) - common)
            keep = sim >= threshold - 1e-12
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep)), pa.array(sim[keep])], names=["a", "b", "similarity"])

    return run


def _members(ids: DataFrame, bits: int = 24):
    """Which fingerprints may be among ``ids`` (column ``fp``): a bitmap of their leading bits, 2 MB at any size of data.

    Words of it are put together before they come to the driver, 2**18 of them at most.
    """
    slot = F.conv(F.hex(F.substring("fp", 1, bits // 8)), 16, 10).cast("long")
    words_ = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("m")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), "u8")
    bitmap[words_.column("w").to_numpy()] = words_.column("m").to_numpy().view("u8")
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = _prints(b.column("fp"))[:, 0].astype("u8") >> np.uint64(64 - bits)
                hit = shared.value[(s >> np.uint64(6)).astype("i8")] >> (s & np.uint64(63)) & np.uint64(1)
                yield b.filter(pa.array(hit.astype(bool)))

    return run


def _slim(records: DataFrame, ids: DataFrame) -> DataFrame:
    """``fp, n, pivots`` of the texts that may be among ``ids``, so that no others are moved; equal texts have equal columns."""
    few = records.select("fp", "n", "pivots").mapInArrow(_members(ids), "fp binary, n int, pivots binary")
    return few.groupBy("fp").agg(F.first("n").alias("n"), F.first("pivots").alias("pivots"))


def _survivors(pairs: DataFrame, records: DataFrame, threshold: float, sigmas: float) -> DataFrame:
    """``a, b``: the pairs that pass sizes and pivots."""
    slim = _slim(records, pairs.select(F.explode(F.array("a", "b")).alias("fp")))
    left = slim.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("pivots").alias("pa"))
    right = slim.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("pivots").alias("pb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_near(sigmas, threshold), "a binary, b binary")


def _links(survivors: DataFrame, records: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of the pairs that pass the exact test."""
    survivors = written(survivors, "near-survivors")
    # only the runs of survivors are moved
    ids = survivors.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    few = records.select("fp", "runs").mapInArrow(_members(ids), "fp binary, runs binary")
    runs = few.join(ids, "fp", "left_semi").groupBy("fp").agg(F.first("runs").alias("runs"))
    ra, rb = runs.select(F.col("fp").alias("a"), F.col("runs").alias("ra")), runs.select(F.col("fp").alias("b"), F.col("runs").alias("rb"))
    return survivors.join(ra, "a").join(rb, "b").select("a", "b", "ra", "rb").mapInArrow(_verify(threshold), "a binary, b binary, similarity double")


def _met(threshold: float, sigmas: float, across: bool):
    """Pairs of two blocks of a bucket that pass sizes and pivots, each in the least of the large buckets its members share."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sides = []
        for side in (0, 1):
            t = group.filter(pa.array(group.column("side").to_numpy() == side))
            if not t.num_rows:
                return _EMPTY_PAIRS
            raw = t.column("fp").to_pylist()
            sides.append((raw, t.column("n").to_numpy().astype("f8"), np.frombuffer(b"".join(t.column("pivots").to_pylist()), "i1").reshape(len(raw), -1).astype("i2"), t.column("bigs").to_pylist(), t.column("component").to_pylist(), t.column("main").to_pylist()))
        (x, nx, px, bx, cx, _), (y, ny, py, by, cy, my) = sides
        big, one = group.column("big")[0].as_py(), group.column("i")[0].as_py() == group.column("j")[0].as_py()
        out_a, out_b = [], []
        for i in range(len(x)):
            most = limit(nx[i] + ny, threshold, sigmas)
            at = np.flatnonzero(np.minimum(nx[i], ny) >= threshold * np.maximum(nx[i], ny) - 1e-9)
            step = 0
            while step < px.shape[1] and len(at):  # most are gone after few coordinates
                part = slice(step, step + 16)
                at = at[np.abs(py[at, part] - px[i, part]).max(axis=1) <= most[at]]
                step += 16
            for j in at.tolist():
                # a member of the main component stands on the second side alone
                if (cx[i] != cy[j] and (my[j] or x[i] < y[j]) if across else not one or x[i] < y[j]) and min(set(bx[i]).intersection(by[j])) == big:
                    out_a.append(min(x[i], y[j]))
                    out_b.append(max(x[i], y[j]))
        return pa.Table.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])

    return run


_EMPTY_PAIRS = pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})


def _large(pairs: DataFrame, records: DataFrame, group: DataFrame | None, threshold: float, sigmas: float, block: int = BLOCK) -> DataFrame:
    """``a < b``: pairs of members of the buckets named in ``big`` that pass sizes and pivots, each once.

    A bucket's members are dealt to blocks of about ``block``, and each two blocks meet under
    a key of their own, where the pivots discard pairs before any is given out. With ``group``
    (``node, component``) only pairs of two components are wanted: then the members outside a bucket's
    largest component meet all others, so that one large family costs no more than its size.
    """
    member = written(pairs.where("big is not null").select("big", F.explode(F.array("a", "b")).alias("fp")).distinct(), "near-large")
    shared = member.groupBy("fp").agg(F.collect_list("big").alias("bigs"))  # no more than the bands
    dealt = member.join(shared, "fp").join(_slim(records, member), "fp")
    if group is None:
        dealt = dealt.withColumns({"component": F.lit(None).cast("binary"), "main": F.lit(False)})
    else:
        dealt = dealt.join(group.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        sizes = dealt.groupBy("big", "component").agg(F.count("*").alias("m")).groupBy("big").agg(F.max_by("component", F.struct("m", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
        dealt = dealt.join(sizes.select("big", "top"), "big").withColumn("main", F.col("component") == F.col("top")).drop("top")
    dealt = written(dealt, "near-dealt")
    few = dealt if group is None else dealt.where("not main")
    blocks = lambda df, name: df.groupBy("big").agg(F.ceil(F.count("*") / block).alias(name))
    n_x, n_y = blocks(few, "nx"), blocks(dealt, "ny")
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    zero = F.lit(0).cast("long")
    cols = ["fp", "n", "pivots", "bigs", "component", "main"]
    x = few.join(n_y, "big").join(n_x, "big").withColumn("i", own("nx")).select("big", "i", F.explode(F.sequence(zero, F.col("ny") - 1)).alias("j"), F.lit(0).alias("side"), *cols)
    y = dealt.join(n_x, "big").join(n_y, "big").withColumn("j", own("ny")).select("big", F.explode(F.sequence(zero, F.col("nx") - 1)).alias("i"), "j", F.lit(1).alias("side"), *cols)
    both = x.unionByName(y)
    if group is None:  # of the blocks of one bucket each two meet once
        both = both.where("i <= j")
    return both.groupBy("big", "i", "j").applyInArrow(_met(threshold, sigmas, group is not None), "a binary, b binary")


def near_duplicates(
    df: DataFrame,
    kind: Column,
    record_id: Column,
    text: Column,
    *,
    size: int = 5,
    threshold: float = 0.8,
    min_words: int = 0,
    bands: int = 24,
    rows: int = 5,
    pivots: int = 256,
    sigmas: float = 4.5,
    small: int = SMALL_BUCKET,
    count_links: bool = True,
) -> DataFrame:
    """``kind, id, group_id, links``: each record's closed group of near copies.

    Records of one kind are linked if the Jaccard similarity of their runs of
    ``size`` words is at least ``threshold``; groups are closed. Only records
    with ``min_words`` words, and one run at least, come out; null or empty
    texts and null ids don't. Repeated rows of an id count once, if their texts
    differ the one with the greatest fingerprint does. Equal texts share one
    record through the search. ``links``: number of different other texts that this text
    is linked with. Without ``count_links`` there is no such column, and large buckets are tested only as far
    as groups need it. ``group_id`` is the least id of the group.

    A pair at similarity s becomes a candidate with probability
    1 - (1 - s**rows)**bands; the pivots then lose one at the threshold with a
    probability of ``pivots`` times that of ``sigmas`` standard deviations, 2e-3 by default, and a
    closer one with less. Pairs without common runs pass them with a probability of about 0.01 at a threshold of 0.6, and of 1e-6 at 0.8.
    """
    source = df.select(kind.alias("kind"), record_id.cast("string").alias("id"), text.alias("text")).where("kind is not null and id is not null and text is not null")
    records = written(source.mapInArrow(_records(size, min_words, Pivots(pivots)), "kind string, id string, fp binary, n int, runs binary, pivots binary"), "near-records")
    banded = records.select("kind", "fp", "runs").mapInArrow(_bands(bands, rows), "band long, fp binary")
    pairs = written(banded.repartition("band").sortWithinPartitions("band", "fp").mapInArrow(_pairs(small), "a binary, b binary, big long"), "near-pairs")
    large = pairs.where("big is not null").limit(1).count() > 0
    first = pairs.where("big is null") if large and count_links else pairs
    near = _survivors(first.select("a", "b").distinct(), records, threshold, sigmas)
    if large and count_links:
        near = near.unionByName(_large(pairs, records, None, threshold, sigmas)).distinct()
    links = written(_links(near, records, threshold), "near-links")
    if large and not count_links:
        # in large buckets, all pairs between records that are not yet in one group
        across = _large(pairs, records, connected_components(links), threshold, sigmas)
        links = written(links.unionByName(_links(across, records, threshold)).dropDuplicates(["a", "b"]), "near-links")
    group = connected_components(links)
    one = records.groupBy("kind", "id").agg(F.max("fp").alias("fp"))
    grouped = written(one.join(group.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "near-grouped")
    least = grouped.groupBy("component").agg(F.min("id").alias("group_id"))
    named = grouped.join(least, "component").select("fp", "kind", "id", "group_id")
    if not count_links:
        return named.drop("fp")
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    return named.join(degree, "fp", "left").select("kind", "id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))


def group_pairs(groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """``kind, id_a < id_b``: all pairs of each group; for output that must name pairs, as large as it has to be. Members of large groups are met in blocks."""
    blocks = groups.groupBy("kind", "group_id").agg(F.count("*").alias("n")).where("n > 1").select("kind", "group_id", F.ceil(F.col("n") / block).alias("blocks"))
    dealt = groups.select("kind", "group_id", "id").join(blocks, ["kind", "group_id"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    a = dealt.select("kind", "group_id", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"), F.col("id").alias("x"))
    b = dealt.select("kind", "group_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own"))).alias("i"), F.col("own").alias("j"), F.col("id").alias("y"))
    met = a.join(b, ["kind", "group_id", "i", "j"]).where("i < j or x < y")
    return met.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
