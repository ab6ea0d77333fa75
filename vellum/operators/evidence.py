"""Selection of evidence and the lexical gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import anchor_terms, count_tokens, format_pages, normalize_paragraph, query_terms, strip, tokenize_words


def without_repeats(candidates: DataFrame, *, least: int = 120) -> DataFrame:
    """[EVD1, FIL5] Candidates without paragraphs that an earlier candidate of the query has.

    ``candidates``: ``query_id, rank, chunk_id, text`` and others. Of rows of one chunk the first by
    rank stays; rows without chunk id or text drop out. Paragraphs are compared with
    single spaces in lower case and only from ``least`` characters on; the first in (rank, position) wins.
    """
    q = Window.partitionBy("query_id", "chunk_id").orderBy("rank", "text")
    first = candidates.where(F.col("chunk_id").isNotNull() & (strip(F.col("chunk_id")) != "")).withColumn("_n", F.row_number().over(q)).where("_n = 1").drop("_n")
    parts = first.select("query_id", "chunk_id", "rank", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "p")).withColumn("p", strip(F.col("p"))).where("p <> ''")
    norm = normalize_paragraph(F.col("p"))
    long = F.length(norm) >= least
    # hashed, so that long paragraphs are not the keys of a shuffle; short ones are keys of their own
    same = Window.partitionBy("query_id", F.when(long, F.sha2(norm, 256)).otherwise(F.concat_ws("|", "chunk_id", F.col("pos").cast("string")))).orderBy("rank", "chunk_id", "pos")
    kept = parts.withColumn("n", F.row_number().over(same)).where("n = 1")
    texts = kept.groupBy("query_id", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]), "\n\n").alias("text"))
    return first.drop("text").join(texts, ["query_id", "chunk_id"])


def select_evidence(candidates: DataFrame, k: int, budget: int, *, least_tokens: int = 20, pool: int | None = None) -> DataFrame:
    """[EVD2, EVD3] At most k candidates a query within a budget of tokens, with ``source_id`` 'S1'… and ``token_count``.

    After repeats are removed, texts under ``least_tokens`` drop out. The rest are taken by rank
    as long as they fit; one that doesn't is passed over, a later smaller one may fit. Candidates of one
    query are as many as the search gave, and all are folded; ``pool`` leaves out those of greater rank.
    """
    if k <= 0 or budget <= 0:
        raise ValueError("k and budget must be positive")
    sized = without_repeats(candidates).withColumn("token_count", count_tokens(F.col("text"))).where(F.col("token_count") >= least_tokens)
    if pool is not None:
        sized = sized.where(F.col("rank") <= pool)
    # a search gives a bounded number of candidates, so a query's list is bounded
    lists = sized.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.col("token_count").cast("long").alias("n")))).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))

    def take(a: Column, x: Column) -> Column:
        fits = (F.size(a["kept"]) < k) & (a["used"] + x["n"] <= budget)
        return F.when(fits, F.struct((a["used"] + x["n"]).alias("used"), F.concat(a["kept"], F.array(x["chunk_id"])).alias("kept"))).otherwise(a)

    chosen = lists.select("query_id", F.posexplode(F.aggregate("c", start, take, lambda a: a["kept"])).alias("i", "chunk_id"))
    return sized.join(chosen, ["query_id", "chunk_id"]).withColumn("source_id", F.concat(F.lit("S"), (F.col("i") + 1).cast("string"))).drop("i")


def evidence_context(evidence: DataFrame) -> DataFrame:
    """[AGG9, AGG5] ``query_id, context, tokens``: the evidence of each query as one text, in order of its ids.

    ``evidence``: ``query_id, source_id, filename, page_start, page_end, section, chunk_type, title, author, text, token_count``, a few rows a query.
    Lines for title and author stand only where they have some.
    """
    lines = [
        F.concat(F.lit("["), "source_id", F.lit("]")),
        F.concat(F.lit("File: "), F.coalesce("filename", F.lit(""))),
        F.concat(F.lit("Page(s): "), F.coalesce(format_pages(F.col("page_start"), F.col("page_end")), F.lit(""))),
        F.concat(F.lit("Section: "), F.coalesce("section", F.lit(""))),
        F.concat(F.lit("Type: "), F.coalesce("chunk_type", F.lit(""))),
        F.when(F.col("title") != "", F.concat(F.lit("Title: "), "title")),
        F.when(F.col("author") != "", F.concat(F.lit("Author: "), "author")),
    ]
    block = F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    n = F.substring("source_id", 2, 9).cast("int")
    rows = evidence.select("query_id", n.alias("n"), "source_id", block.alias("block"), "token_count")
    ordered = F.array_sort(F.collect_list(F.struct("n", "source_id", "block")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda s: s["block"]), "\n\n" + "=" * 72 + "\n\n").alias("context"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))


def lexical_gate(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """[GAT1, JON5] ``query_id, sufficient, reason, terms, anchors, matched``.

    ``questions``: ``query_id, question``; ``evidence``: ``query_id, text``.
    Terms of the question are looked for among the words of its evidence. It is not
    sufficient if there are anchors and none is found, or terms and none is
    found. A question without terms passes. Words are met by key, one row a word.
    """
    q = questions.select("query_id", query_terms(F.col("question")).alias("terms"))
    asked = q.select("query_id", F.posexplode("terms").alias("i", "w"))
    seen = evidence.select("query_id", F.explode(F.array_distinct(tokenize_words(F.col("text")))).alias("w")).distinct()
    met = asked.join(seen, ["query_id", "w"]).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("matched"))
    x = q.join(met, "query_id", "left").withColumns({"matched": F.coalesce("matched", F.array().cast("array<string>")), "anchors": anchor_terms(F.col("terms"))})
    no_anchor = (F.size("anchors") > 0) & (F.size(F.array_intersect("anchors", "matched")) == 0)
    no_term = (F.size("terms") > 0) & (F.size("matched") == 0)
    reason = F.when(no_anchor, "no distinctive term found").when(no_term, "no term found").otherwise("terms found")
    return x.select("query_id", (~no_anchor & ~no_term).alias("sufficient"), reason.alias("reason"), "terms", "anchors", "matched")
