"""A library of paged documents: discovery, extraction, exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import sha256_of, strip
from vellum.operators.layout import layout_clean

PAGE_SCHEMA = (
    "path string, page_ordinal int, text string, metadata map<string,string>, toc_items array<string>, page_boxes array<struct<box_index:int,box_class:string,char_span:array<int>>>"
)


def discover(spark: SparkSession, root: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """[SRC1] Files below ``root`` with their content: ``path, modified_at, size, content``, in order of the lower-case path.

    A local root that is missing or no folder is an error. The order is that of the rows when collected; the scan itself stays parallel.
    """
    local = root.removeprefix("file://")
    if local.startswith("/"):
        if not Path(local).exists():
            raise FileNotFoundError(root)
        if not Path(local).is_dir():
            raise NotADirectoryError(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), "content").orderBy(F.lower("path"), "path")


def scan_library(spark: SparkSession, root: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """[IDX3, TXT1] ``path, normalized_path, sha256`` of each file."""
    files = discover(spark, root, pattern)
    return files.select("path", F.lower("path").alias("normalized_path"), sha256_of(F.col("content")).alias("sha256"))


def extract_pages(files: DataFrame, extractor: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    """[SRC2] Pages of each file by a pluggable ``extractor(path, content)``, which gives dicts of ``PAGE_SCHEMA``'s fields.

    A file that can't be read fails the job, as no half library may be published.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "page_ordinal", "text", "metadata", "toc_items", "page_boxes"]
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                rows = [{"path": path, **{n: p.get(n) for n in names[1:]}} for p in extractor(path, bytes(content))]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def page_number(metadata: Column, ordinal: Column) -> Column:
    """[SRC3] The page number of the metadata where it is a number, else the page's place."""
    return F.coalesce(F.try_element_at(metadata, F.lit("page_number")).try_cast("int"), ordinal)


def parsed_documents(pages: DataFrame, files: DataFrame) -> DataFrame:
    """[SRC3] One row a file: ``document_id, path, filename, sha256, page_count, title, author``; title and author are the first of its pages that aren't blank."""

    def first(key: str) -> Column:
        v = F.nullif(strip(F.try_element_at(F.col("metadata"), F.lit(key))), F.lit(""))
        return F.min(F.when(v.isNotNull(), F.struct(F.col("page_ordinal"), v.alias("v"))))["v"]

    of_pages = pages.groupBy("path").agg(F.count("*").alias("page_count"), first("title").alias("title"), first("author").alias("author"))
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), sha256_of(F.col("content")).alias("sha256"))
    return named.join(of_pages, "path", "left").select(F.substring("sha256", 1, 24).alias("document_id"), "path", "filename", "sha256", F.coalesce("page_count", F.lit(0)).alias("page_count"), "title", "author")


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """[TXT4] Adds ``body`` and ``captions`` to pages with ``raw_text`` and ``page_boxes``."""
    c = layout_clean(F.col("raw_text"), F.col("page_boxes"))
    return pages.drop("captions").withColumn("_c", c).select("*", F.col("_c.body").alias("body"), F.col("_c.captions").alias("captions")).drop("_c")


def document_statistics(pages: DataFrame) -> DataFrame:
    """[AGG1] Of each document: pages, characters, raw characters, empty pages, pages with contents, with layout, captions."""
    n = F.length(F.coalesce("text", F.lit("")))
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return pages.groupBy("document_id").agg(
        F.count("*").alias("pages"),
        F.sum(n).alias("chars"),
        F.sum(F.length(F.coalesce("raw_text", F.lit("")))).alias("raw_chars"),
        F.count_if(strip(F.coalesce("text", F.lit(""))) == "").alias("empty_pages"),
        F.count_if(has("toc_items")).alias("pages_with_toc"),
        F.count_if(has("page_boxes")).alias("pages_with_layout"),
        F.sum(F.greatest(F.coalesce(F.size("captions"), F.lit(0)), F.lit(0))).alias("captions"),
    )


def markdown_export(documents: DataFrame, pages: DataFrame, *, text: str = "text", captions: bool = True) -> DataFrame:
    """[SRC11, SRC12] ``document_id, page_order, part``: a document as Markdown, a row a page and one for its head (page_order -1).

    Written with ``write_text`` the parts of a document follow each other; they are not gathered into one value.
    ``text='raw_text', captions=False`` gives the raw export.
    """
    head = documents.select("document_id", F.lit(-1).cast("long").alias("page_order"), F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("filename", F.lit(""))), F.concat(F.lit("Source: "), "source_path"), F.concat(F.lit("SHA-256: "), "sha256"), F.when(strip(F.col("title")) != "", F.concat(F.lit("Title: "), "title")), F.when(strip(F.col("author")) != "", F.concat(F.lit("Author: "), "author"))).alias("part"))
    lines = [F.concat(F.lit("<!-- page "), F.coalesce(F.col("page_number").cast("string"), F.lit("?")), F.lit(" -->")), F.coalesce(F.col(text), F.lit(""))]
    if captions:
        lines.append(F.when(F.size("captions") > 0, F.concat(F.lit("Captions:\n"), F.array_join(F.transform("captions", lambda c: F.concat(F.lit("- "), c)), "\n"))))
    body = pages.select("document_id", F.col("page_order").cast("long").alias("page_order"), F.concat_ws("\n\n", *lines).alias("part"))
    return head.unionByName(body)


def write_text(parts: DataFrame, path: str) -> None:
    """[SRC11] Text files of the parts, in order of document and page, one folder a run."""
    parts.repartitionByRange("document_id").sortWithinPartitions("document_id", "page_order").select("part").write.mode("errorifexists").text(path)


def write_chunks_json(chunks: DataFrame, path: str) -> None:
    """[SRC13] Chunks as JSON lines."""
    chunks.write.mode("errorifexists").json(path)


def chunk_report(chunks: DataFrame) -> DataFrame:
    """[SRC14] ``document_id, chunk_index, part``: each chunk under a heading with its place and size."""
    head = F.format_string("## Chunk %d\n\nPages: %s-%s  \nSection: %s  \nType: %s  \nTokens: %d", "chunk_index", F.coalesce(F.col("page_start").cast("string"), F.lit("?")), F.coalesce(F.col("page_end").cast("string"), F.lit("?")), F.coalesce("section", F.lit("")), F.coalesce("chunk_type", F.lit("")), "token_count")
    return chunks.select("document_id", "chunk_index", F.concat(head, F.lit("\n\n"), "text").alias("part"))
