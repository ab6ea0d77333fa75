"""Reports at the console: ``python -m vellum COMMAND``, on Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import format_pages, preview
from vellum.operators.chunking import chunk_statistics
from vellum.operators.retrieval import bm25, build_index
from vellum.plans.sync import document_state, sync_plan
from vellum.sources.library import document_statistics, scan_library
from vellum.sources.store import Store


def _print_all(df: DataFrame) -> None:
    """All rows below their names, parted by tabs; a partition at a time comes to the driver."""
    print(*df.columns, sep="\t")
    for row in df.toLocalIterator():
        print(*("" if x is None else x for x in row), sep="\t")


def main(argv: list[str] | None = None) -> None:
    """[CLI2, CLI4, CLI6] search, plan, compact, chunks, pages."""
    p = argparse.ArgumentParser(prog="vellum", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="the best chunks for a question")
    s.add_argument("store")
    s.add_argument("question")
    s.add_argument("--top-k", type=int, default=5)
    s.add_argument("--preview-chars", type=int, default=300)
    s.add_argument("--full", action="store_true")
    s = sub.add_parser("plan", help="what a sync would do")
    s.add_argument("store")
    s.add_argument("root")
    s = sub.add_parser("compact", help="rewrite the table in fewer files")
    s.add_argument("store")
    s.add_argument("--files", type=int, default=1)
    for name in ("chunks", "pages"):
        s = sub.add_parser(name, help=f"statistics of a table of {name}")
        s.add_argument("table")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("vellum").getOrCreate()
    if a.command == "search":
        if not a.question.strip() or a.top_k <= 0:
            p.error("a question and a positive number are needed")
        table = Store(spark, a.store).open()
        index, stats = build_index(table, "chunk_id", F.col("text"))
        asked = spark.createDataFrame([(0, a.question)], "query_id int, question string")
        hits = bm25(index, stats, asked, a.top_k).join(table.withColumnRenamed("chunk_id", "id"), "id").orderBy("rank")
        text = F.col("text") if a.full else preview(F.col("text"), a.preview_chars)
        hits.select("rank", F.round("score", 4).alias("score"), "filename", format_pages(F.col("page_start"), F.col("page_end")).alias("pages"), "section", text.alias("text")).show(a.top_k, truncate=False, vertical=True)
    elif a.command == "plan":
        plan = sync_plan(scan_library(spark, a.root), document_state(Store(spark, a.store).open()))
        plan.groupBy("status").count().orderBy("status").show()
        _print_all(plan.where("status <> 'UNCHANGED'").select("status", "normalized_path").orderBy("status", "normalized_path"))
    elif a.command == "compact":
        print(Store(spark, a.store).compact(a.files) or "done")
    else:
        table = spark.read.parquet(a.table)
        _print_all(chunk_statistics(table) if a.command == "chunks" else document_statistics(table).orderBy("document_id"))


if __name__ == "__main__":
    main()
