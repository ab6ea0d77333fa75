"""From blocks to chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import count_tokens, stable_id, strip

#: A token with the white space before it, so that tokens joined give the text.
SPACED_TOKEN = r"\s*(?:[\p{L}\p{N}]+|[^\s\p{L}\p{N}])"
#: Pages of a document that are numbered together.
PAGE_BLOCK = 4096
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9(\[])"


@dataclass(frozen=True)
class ChunkSizes:
    """Sizes of chunks in tokens."""

    target: int = 550
    overlap: int = 100
    least: int = 180
    most: int = 700
    cross_page: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.target <= self.most:
            raise ValueError("0 < least <= target <= most must hold")
        if not 0 <= self.overlap < self.target:
            raise ValueError("0 <= overlap < target must hold")


def split_long(text: Column, sizes: ChunkSizes = ChunkSizes()) -> Column:
    """[GEN6] Segments of a text: itself if it is short enough, else sentences packed to the target, else slices of tokens that overlap."""
    t = strip(text)

    def slices(s: Column) -> Column:
        spaced = F.regexp_extract_all(s, F.lit(SPACED_TOKEN), F.lit(0))
        n, stride = F.size(spaced), sizes.target - sizes.overlap
        # a slice that begins within the overlap before the end adds nothing
        starts = F.sequence(F.lit(0), F.greatest(n - sizes.overlap - 1, F.lit(0)), F.lit(stride))
        return F.transform(starts, lambda i: strip(F.array_join(F.slice(spaced, i + 1, F.lit(sizes.target)), "")))

    sentences = F.filter(F.transform(F.split(t, SENTENCE_GAP), strip), lambda s: s != "")
    sized = F.transform(sentences, lambda s: F.struct(s.alias("s"), count_tokens(s).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def pack(a: Column, x: Column) -> Column:
        full = (a["open"] != "") & (a["n"] + x["n"] > sizes.target)
        done = F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        fresh = full | (a["open"] == "")
        huge = fresh & (x["n"] > sizes.most)
        return (
            F.when(huge, F.struct(F.concat(done, slices(x["s"])).alias("done"), F.lit("").alias("open"), F.lit(0).alias("n")))
            .when(fresh, F.struct(done.alias("done"), x["s"].alias("open"), x["n"].alias("n")))
            .otherwise(F.struct(done.alias("done"), F.concat(a["open"], F.lit(" "), x["s"]).alias("open"), (a["n"] + x["n"]).alias("n")))
        )

    packed = F.aggregate(sized, start, pack, lambda a: F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    return F.when(count_tokens(t) <= sizes.most, F.array(t)).when(F.size(sentences) <= 1, slices(t)).otherwise(packed)


def segments(blocks: DataFrame, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """[FIL2, FIL3, GEN7] Segments of all blocks but headings and blank ones, numbered by ``seg`` within a block."""
    body = blocks.where(~F.col("is_heading") & (strip(F.col("text")) != ""))
    return body.select("document_id", "page_order", "pos", F.posexplode(split_long(F.col("text"), sizes)).alias("seg", "text"), "page_number", "section", "chunk_type").where("text <> ''")


_COUNT = re.compile(r"[^\W_]+|[^\s\w]|_")
_SPACED = re.compile(r"\s*(?:[^\W_]+|[^\s\w]|_)")


def _assembled(sizes: ChunkSizes):
    """Fold the segments of each run to groups of (segment texts, pages)."""

    def size(texts: list[str]) -> int:
        return sum(len(_COUNT.findall(t)) for t in texts)

    def tail(group: list[dict]) -> list[dict]:
        out, room = [], sizes.overlap
        for s in reversed(group):
            n = size([s["text"]])
            if n > room:
                rest = "".join(_SPACED.findall(s["text"])[-room:]).strip() if room else ""
                if rest:
                    out.append({**s, "text": rest})
                break
            out.append(s)
            room -= n
        return out[::-1]

    def groups(run: list[dict]) -> Iterator[list[dict]]:
        now: list[dict] = []
        for s in run:
            texts = [x["text"] for x in now]
            if not now:
                now = [s]
                continue
            joined = size([*texts, s["text"]])
            if joined <= sizes.target or (size(texts) < sizes.least and joined <= sizes.most):
                now.append(s)
                continue
            yield now
            now = tail(now)
            if size([x["text"] for x in now]) + size([s["text"]]) > sizes.most:
                now = []
            now.append(s)
        if now:
            yield now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("document_id", "area", "run", "part", "text", "page_start", "page_end", "section", "chunk_type")}
            for row in b.to_pylist():
                for i, g in enumerate(groups(row["segs"])):
                    pages = [x["page_number"] for x in g if x["page_number"] is not None]
                    values = (row["document_id"], row["area"], row["run"], i, "\n\n".join(x["text"] for x in g), min(pages, default=None), max(pages, default=None), g[0]["section"], g[0]["chunk_type"])
                    for k, v in zip(out, values):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("document_id", pa.string()), ("area", pa.int64()), ("run", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("page_start", pa.int32()), ("page_end", pa.int32()), ("section", pa.string()), ("chunk_type", pa.string())]))

    return run


def assemble_chunks(segs: DataFrame, documents: DataFrame, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """[GEN8-GEN12, AGG11, TXT24] Chunks of documents: ``chunk_id, document_id, chunk_index, page_start, page_end, section, chunk_type, text, token_count``.

    A run of segments of one section, type and page (or pages, with
    ``cross_page``) is folded by itself, as no chunk and no overlap goes beyond one.
    ``documents``: ``document_id, sha256``. Documents without segments give none; null sections or types are values of their own.
    """
    # runs don't go beyond a page, so pages can be numbered apart
    area = F.lit(0).cast("long") if sizes.cross_page else F.col("page_order").cast("long")
    x = segs.withColumn("area", area)
    order = Window.partitionBy("document_id", "area").orderBy("page_order", "pos", "seg")
    changed = ~F.col("section").eqNullSafe(F.lag("section").over(order)) | ~F.col("chunk_type").eqNullSafe(F.lag("chunk_type").over(order))
    numbered = x.withColumn("new", F.when(F.row_number().over(order) == 1, True).otherwise(changed).cast("long")).withColumn("run", F.sum("new").over(order))
    runs = numbered.groupBy("document_id", "area", "run").agg(F.array_sort(F.collect_list(F.struct("page_order", "pos", "seg", F.col("text"), F.col("page_number").cast("int").alias("page_number"), "section", "chunk_type"))).alias("segs"))
    parts = runs.mapInArrow(_assembled(sizes), "document_id string, area long, run long, part int, text string, page_start int, page_end int, section string, chunk_type string")
    # chunks are numbered through a document in two steps: within blocks of pages, and by what the blocks before hold
    parts = parts.withColumn("block", F.floor(F.col("area") / PAGE_BLOCK))
    before = parts.groupBy("document_id", "block").agg(F.count("*").alias("n")).select("document_id", "block", F.coalesce(F.sum("n").over(Window.partitionBy("document_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("document_id", "block").orderBy("area", "run", "part")) - 1
    indexed = parts.withColumn("place", place).join(before, ["document_id", "block"]).withColumn("chunk_index", (F.col("place") + F.col("before")).cast("int"))
    parts_of_id = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sha256", "chunk_index", "page_start", "page_end", "section", "chunk_type", "text")]
    return indexed.join(documents.select("document_id", "sha256"), "document_id").select(
        stable_id(parts_of_id).alias("chunk_id"), "document_id", "chunk_index", "page_start", "page_end", "section", "chunk_type", "text", count_tokens(F.col("text")).alias("token_count")
    )


def chunk_statistics(chunks: DataFrame, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """[AGG2] One row: number of chunks, tokens in all, least, most and mean, how many lie outside the sizes; zeros where there are none."""
    n = F.col("token_count")
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.coalesce(F.sum(n), F.lit(0)).alias("tokens"),
        F.coalesce(F.min(n), F.lit(0)).alias("least"),
        F.coalesce(F.max(n), F.lit(0)).alias("most"),
        F.round(F.coalesce(F.avg(n), F.lit(0.0)), 4).alias("mean"),
        F.count_if(n < sizes.least).alias("below"),
        F.count_if(n > sizes.most).alias("above"),
    )
