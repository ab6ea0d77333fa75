"""Keeping a stored index in step with a library."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.headings import is_searchable
from vellum.functions.text import strip
from vellum.sources.store import Store, merged, without_paths


def document_state(chunks: DataFrame) -> DataFrame:
    """[AGG3, SRC6] ``normalized_path, source_paths, sha256s, row_count`` of an index, from two of its columns.

    Rows without path don't count; hashes are stripped and lower case, blank ones are left out. Distinct values come
    together before they are gathered, so a path with many rows costs no more than its distinct hashes.
    """
    h = F.nullif(F.lower(strip(F.col("source_sha256"))), F.lit(""))
    rows = chunks.select(F.lower("source_path").alias("normalized_path"), "source_path", h.alias("h")).where("source_path is not null")
    few = rows.groupBy("normalized_path", "source_path", "h").agg(F.count("*").alias("n"))
    return few.groupBy("normalized_path").agg(F.array_sort(F.collect_set("source_path")).alias("source_paths"), F.array_sort(F.collect_set("h")).alias("sha256s"), F.sum("n").alias("row_count"))


def sync_plan(library: DataFrame, state: DataFrame) -> DataFrame:
    """[JON1] ``normalized_path, path, sha256, status``: NEW, CHANGED, UNCHANGED or DELETED of each path.

    ``library``: ``path, normalized_path, sha256``, of repeated paths the greatest holds. Unchanged is only what is indexed with exactly its present hash.
    """
    now = library.where("normalized_path is not null").groupBy("normalized_path").agg(F.max(F.struct("path", F.lower("sha256").alias("sha256"))).alias("f")).select("normalized_path", "f.path", "f.sha256")
    x = now.join(state.select("normalized_path", "sha256s", F.lit(True).alias("indexed")), "normalized_path", "full_outer")
    same = (F.size("sha256s") == 1) & (F.col("sha256s")[0] == F.col("sha256"))
    status = F.when(F.col("indexed").isNull(), "NEW").when(F.col("path").isNull(), "DELETED").when(F.coalesce(same, F.lit(False)), "UNCHANGED").otherwise("CHANGED")
    return x.select("normalized_path", "path", "sha256", status.alias("status"))


def records(documents: DataFrame, chunks: DataFrame, model_name: str) -> DataFrame:
    """[IDX1] Rows of the index: chunks with their document's columns; only searched types. ``chunks`` has ``vector``."""
    d = documents.select("document_id", "filename", "source_path", F.col("sha256").alias("source_sha256"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author", F.lit("")).alias("author"))
    return chunks.where(is_searchable(F.col("chunk_type"))).join(d, "document_id").select(
        "chunk_id", "document_id", "filename", "source_path", "source_sha256", "title", "author", "page_start", "page_end", "section", "chunk_type", "text", "token_count", F.lit(model_name).alias("embedding_model"), "vector"
    )


def index_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """[AGG6] One row: documents, chunks, searched chunks, documents without any, dimensions."""
    per = chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(is_searchable(F.col("chunk_type"))).alias("s"), F.max(F.size("vector")).alias("dim"))
    x = documents.select("document_id").distinct().join(per, "document_id", "left")
    return x.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("s"), F.lit(0)).alias("searchable"), F.count_if(F.coalesce("s", F.lit(0)) == 0).alias("skipped"), F.max("dim").alias("dimension"))


def vector_checks(dimension: int) -> dict:
    """[VEC7] What no row of a new version may be."""
    return {"a vector of another dimension": F.coalesce(F.size("vector"), F.lit(-1)) != dimension, "no chunk id": F.col("chunk_id").isNull()}


@dataclass(frozen=True)
class SyncSummary:
    new: int
    changed: int
    unchanged: int
    deleted: int
    rows: int | None
    warning: str | None = None


def sync_index(store: Store, library: DataFrame, prepare, *, dimension: int, dry_run: bool = False, sync_deletions: bool = False, compact_to: int | None = None) -> SyncSummary:
    """[IDX5, IDX4] Bring the index in step with the library, as one new version.

    ``prepare(files)`` gives the index rows of the files that are new or changed (``path, sha256``). A file without
    searched chunks is an error. Deleted ones go only if asked for. A dry run, or nothing to do, writes nothing.
    """
    plan = sync_plan(library, document_state(store.open())).persist()
    try:
        n = {r["status"]: r["count"] for r in plan.groupBy("status").count().collect()}  # four rows at most
        count = [n.get(s, 0) for s in ("NEW", "CHANGED", "UNCHANGED", "DELETED")]
        todo = count[0] + count[1] + (count[3] if sync_deletions else 0)
        if dry_run or not todo:
            return SyncSummary(*count, None)
        files = plan.where("status in ('NEW', 'CHANGED')").select("path", "sha256", "normalized_path")
        rows = prepare(files)
        lacking = files.join(rows.select(F.lower("source_path").alias("normalized_path")).distinct(), "normalized_path", "left_anti")
        if not lacking.isEmpty():
            raise ValueError("a document has no searchable chunks")
        table = store.open()
        gone = "status = 'CHANGED'" + (" or status = 'DELETED'" if sync_deletions else "")
        scope = table.select("source_path").distinct().join(plan.where(gone).select("normalized_path"), F.lower("source_path") == F.col("normalized_path"), "left_semi")
        left = merged(table, rows, scope) if count[0] + count[1] else without_paths(table, scope)
        published = store.publish(left, vector_checks(dimension))
        return SyncSummary(*count, published, store.compact(compact_to) if compact_to else None)
    finally:
        plan.unpersist()
