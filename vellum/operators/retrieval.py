"""Lexical search, fusion of rankings and refinement of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import caption_like, query_terms, safe_double, tokenize_words
from vellum.plans.shared import written

# Fixed values of refinement, by chunk type.
WEIGHTS = {"methods": 0.97, "supplementary": 0.92}
CAPTION_WEIGHT = 0.80
RRF_K = 60


def _texts(df: DataFrame, id_col: str, text: Column, unique: bool) -> DataFrame:
    named = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("text"))
    return named if unique else named.groupBy("id").agg(F.max("text").alias("text"))


def postings(df: DataFrame, id_col: str, text: Column, *, unique: bool = False) -> DataFrame:
    """[SRC17] ``term, id, tf, dl``: how often each word stands in each text, and the text's length in words.

    Texts without words, null texts and null ids have no postings; a repeated id counts as one text, the greatest. Where ids are known to be
    ``unique``, the texts need not be moved to find repeats. Words are counted within each text, so what is shuffled is a row a word and text.
    """
    w = _texts(df, id_col, text, unique).select("id", tokenize_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return w.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def corpus_statistics(df: DataFrame, id_col: str, text: Column, *, unique: bool = False) -> DataFrame:
    """One row: number of texts with words, and their mean length in words."""
    n = F.size(tokenize_words(F.col("text")))
    return _texts(df, id_col, text, unique).select(n.alias("dl")).where("dl > 0").agg(F.count("*").alias("n_texts"), F.avg("dl").alias("mean_dl"))


def bm25(index: DataFrame, statistics: DataFrame, queries: DataFrame, k: int, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """[RET2] ``query_id, id, score, rank``: the k best texts of each query.

    ``queries``: ``query_id, question``; a question without terms finds
    nothing. idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Scores are rounded to 9
    places, ties go to the smaller id. The postings of a term are counted before they
    meet the questions; frequent terms are split by id, not gathered.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    terms = queries.select("query_id", F.explode(query_terms(F.col("question"))).alias("term"))
    wanted = index.join(terms.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    s = statistics.first()  # one row of two numbers
    n, mean = float(s["n_texts"]), float(s["mean_dl"] or 1.0)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean))
    rated = terms.join(df.select("term", idf.alias("idf")), "term")
    scores = wanted.join(rated, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], k: int, *, rrf_k: int = RRF_K) -> DataFrame:
    """[RET3, JON7] ``query_id, id, score, rank`` by reciprocal-rank fusion of frames ``query_id, id, rank``.

    Each ranking gives 1 / (rrf_k + rank); what stands in one only has no part from the others. Ties go to the smaller id.
    """
    if rrf_k <= 0 or k <= 0:
        raise ValueError("k and rrf_k must be positive")
    parts = [r.select("query_id", "id", (F.lit(1.0) / (rrf_k + F.col("rank"))).alias("part")) for r in rankings]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    scores = both.groupBy("query_id", "id").agg(F.round(F.sum("part"), 12).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def type_weight(chunk_type: Column, section: Column) -> Column:
    """[RET4] What a candidate's score is multiplied by; captions are told first."""
    w = F.when(caption_like(chunk_type, section), CAPTION_WEIGHT)
    for kind, x in WEIGHTS.items():
        w = w.when(F.lower(F.trim(chunk_type)) == kind, x)
    return w.otherwise(1.0)


def scored(candidates: DataFrame, *, rrf_k: int = RRF_K) -> DataFrame:
    """[RET5, TXT25] Adds ``base, weight, refined, caption_like``; a score that is null or none counts as 1 / (rrf_k + rank)."""
    fallback = F.lit(1.0) / (rrf_k + F.col("rank"))
    return candidates.withColumns(
        {"base": F.coalesce(F.nullif(safe_double(F.col("score"), float("-inf")), F.lit(float("-inf"))), fallback), "weight": type_weight(F.col("chunk_type"), F.col("section")), "caption_like": caption_like(F.col("chunk_type"), F.col("section"))}
    ).withColumn("refined", F.col("base") * F.col("weight"))


def refine(candidates: DataFrame, k: int, *, max_captions: int = 2, rrf_k: int = RRF_K) -> DataFrame:
    """[RET6] The k best candidates of each query after weighting, with at most ``max_captions`` captions as long as others are left.

    ``candidates``: ``query_id, id, score, rank, chunk_type, section``. Captions
    beyond the quota come in only where there are fewer than k others. ``final_rank`` orders the result.
    """
    if k <= 0 or max_captions < 0:
        raise ValueError("k must be positive and the quota not negative")
    q = Window.partitionBy("query_id")
    best = [F.desc("refined"), F.desc("base"), F.asc("rank"), F.asc("id")]
    x = scored(candidates, rrf_k=rrf_k).withColumn("ord", F.row_number().over(q.orderBy(*best)))
    x = x.withColumn("captions", F.sum(F.col("caption_like").cast("int")).over(q.orderBy("ord")))
    x = x.withColumn("deferred", F.col("caption_like") & (F.col("captions") > max_captions))
    x = x.withColumn("pick", F.row_number().over(q.orderBy("deferred", "ord"))).where(F.col("pick") <= k)
    x = x.withColumn("final_rank", F.row_number().over(q.orderBy(F.desc("refined"), F.desc("base"), "deferred", "ord")))
    return x.drop("ord", "captions", "pick", "deferred")


def retrieve(index: DataFrame, statistics: DataFrame, queries: DataFrame, chunks: DataFrame, nearest: DataFrame | None, k: int, *, multiplier: int = 3, mode: str = "hybrid", refined: bool = True) -> DataFrame:
    """[RET7, RET8] Candidates of each query: over-fetched, fused, refined.

    ``nearest``: ``query_id, id, rank`` of the vector search. ``mode`` is 'vector' or
    'hybrid'; anything else is a ValueError.
    """
    if mode not in ("vector", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    wide = k * multiplier if refined else k
    if mode == "vector":
        found = nearest.where(F.col("rank") <= wide).select("query_id", "id", (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("score"), "rank")
    else:
        branches = [bm25(index, statistics, queries, wide).select("query_id", "id", "rank")]
        if nearest is not None:
            branches.append(nearest.where(F.col("rank") <= wide).select("query_id", "id", "rank"))
        found = fuse(branches, wide)
    # a chunk's columns come to its candidates, a few a query
    with_types = found.join(chunks.select(F.col("id"), "chunk_type", "section"), "id")
    return refine(with_types, k) if refined else with_types.withColumn("final_rank", F.col("rank"))


def comparison(labelled: dict[str, DataFrame]) -> DataFrame:
    """[RET10] Several rankings below one another, with a label."""
    out = None
    for name, df in labelled.items():
        part = df.select(F.lit(name).alias("label"), "query_id", "rank", "id")
        out = part if out is None else out.unionByName(part)
    return out


def build_index(df: DataFrame, id_col: str, text: Column, *, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """[SRC17] Postings written to the shared folder, and the statistics of the texts."""
    return written(postings(df, id_col, text, unique=unique), "postings"), corpus_statistics(df, id_col, text, unique=unique)
