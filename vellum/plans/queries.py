"""Registered queries of the core and, where SQL can say it, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.headings import BEGINNINGS, NAMES, SEARCHABLE, SUPPLEMENT, heading_type, is_searchable
from vellum.functions.paths import hash_set, path_key
from vellum.operators.answers import claims, claim_prompts, outcomes, prune, render_citations, renumbered, support_check, verification_batches, verify_citations
from vellum.operators.chunking import assemble_chunks, chunk_statistics, segments, split_long
from vellum.operators.evidence import evidence_context, lexical_gate, select_evidence, without_repeats
from vellum.operators.layout import document_blocks, layout_clean, markdown_units, repair_interrupted
from vellum.operators.retrieval import bm25, build_index, comparison, fuse, postings, refine, retrieve, scored
from vellum.operators.snapshot_diff import delivered_versions, snapshot_changes
from vellum.operators.vectors import dimensions, dot, l2_normalize, nearest_neighbours, pooled
from vellum.plans.models import HashingEmbedder, embed_column
from vellum.plans.shared import table, written
from vellum.plans.sync import document_state, index_summary, sync_plan
from vellum.sources.library import chunk_report, document_statistics, markdown_export, page_number
from vellum.sources.store import merged, without_paths
from vellum.streaming.feed import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


P3_VERSIONS = r"""
versions AS (
  SELECT snapshot_no, lower(replace(nfc_normalize(normalized_path), '\', '/')) AS path_key,
         list_sort(list_distinct(list_transform(list_filter(coalesce(sha256s, []), lambda h: h IS NOT NULL), lambda h: lower(h)))) AS hashes,
         delivered_at
  FROM indexed_document_state WHERE normalized_path IS NOT NULL AND snapshot_no IS NOT NULL),
latest AS (
  SELECT * EXCLUDE (delivered_at) FROM versions
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, path_key ORDER BY delivered_at DESC NULLS LAST, hashes DESC) = 1),
snaps AS (
  SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before
  FROM (SELECT DISTINCT snapshot_no FROM indexed_document_state WHERE snapshot_no IS NOT NULL)),
pairs AS (SELECT * FROM snaps WHERE before IS NOT NULL),
changes AS (
  SELECT p.snapshot_no, n.path_key, CASE WHEN o.path_key IS NULL THEN 'added' ELSE 'changed' END AS change_type
  FROM pairs p JOIN latest n USING (snapshot_no)
  LEFT JOIN latest o ON o.snapshot_no = p.before AND o.path_key = n.path_key
  WHERE o.path_key IS NULL OR o.hashes <> n.hashes
  UNION ALL
  SELECT p.snapshot_no, o.path_key, 'removed'
  FROM pairs p JOIN latest o ON o.snapshot_no = p.before
  WHERE NOT EXISTS (SELECT 1 FROM latest n WHERE n.snapshot_no = p.snapshot_no AND n.path_key = o.path_key))
"""


def _p3(spark: SparkSession, sf: str) -> DataFrame:
    state = table(spark, sf, "indexed_document_state")
    versions = delivered_versions(state, "snapshot_no", path_key(F.col("normalized_path")), [F.col("delivered_at")], {"hashes": hash_set(F.col("sha256s"))})
    deliveries = state.select(F.col("snapshot_no").alias("snapshot")).where("snapshot is not null")
    # read four times below: written once, so that the last deliveries are not sought again
    return snapshot_changes(written(versions, "versions"), deliveries).withColumnRenamed("snapshot", "snapshot_no")


@query("p3_found", f"WITH {P3_VERSIONS} SELECT * FROM changes")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Added, removed and changed paths of each delivered snapshot against the one before."""
    return _p3(spark, sf)


@query("p3_change_counts", f"WITH {P3_VERSIONS} SELECT snapshot_no, change_type, count(*) AS n FROM changes GROUP BY ALL")
def p3_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many paths each snapshot added, removed or changed."""
    return _p3(spark, sf).groupBy("snapshot_no", "change_type").agg(F.count("*").alias("n"))


# --- text ---------------------------------------------------------------------------------------------------------
BLANK_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
TOKEN_SQL = r"'[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def _strip(x: str) -> str:
    return f"trim({x}, {BLANK_SQL})"


def _count(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), {TOKEN_SQL}))"


def _norm(x: str) -> str:
    y = f"replace(replace(translate(coalesce({x}, ''), chr(160) || chr(65533) || chr(173), ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return _strip(rf"regexp_replace(regexp_replace({y}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def _heading(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace({_strip(x)}, '^#{{1,6}}\s*', ''), '</?[^>]+>', '', 'g')"
    clean = _strip(f"replace(translate({bare}, '*_', ''), '~~', '')")
    return rf"trim(regexp_replace(regexp_replace(lower({clean}), '[^a-z0-9\s&:/-]', '', 'g'), '\s+', ' ', 'g'))"


def _terms(x: str) -> str:
    words = f"list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9_-]*'), lambda w: lower(w))"
    kept = f"list_filter({words}, lambda w: len(w) >= 4 AND NOT list_contains({STOP_SQL}, w))"
    # distinct in order
    return f"list_filter({kept}, lambda w, i: list_position({kept}, w) = i)"


def _heading_case(h: str) -> str:
    rules = []
    for kind, names in NAMES.items():
        rule = [f"{h} IN ({', '.join(repr(n) for n in names)})"]
        if kind in BEGINNINGS:
            rule.append(f"starts_with({h}, '{BEGINNINGS[kind]}')")
        if kind == "supplementary":
            rule += [f"contains({h}, '{p}')" for p in SUPPLEMENT]
        rules.append(f"WHEN {' OR '.join(rule)} THEN '{kind}'")
    return f"CASE {' '.join(rules)} ELSE 'body' END"


@query("txt1_sha256", "SELECT page_id, sha256(raw_text) AS sha FROM (SELECT DISTINCT page_id, raw_text FROM page_content)")
def txt1_sha256(spark: SparkSession, sf: str) -> DataFrame:
    """TXT1 on page texts."""
    return table(spark, sf, "page_content").select("page_id", "raw_text").distinct().select("page_id", T.sha256_of(F.col("raw_text")).alias("sha"))


BOX_SQL = f"""CASE WHEN raw_text IS NOT NULL AND len(s) = 2 AND s[1] >= 0 AND s[2] > s[1] AND s[1] < length(raw_text)
  THEN {_strip("substring(raw_text, s[1] + 1, least(s[2], length(raw_text)) - s[1])")} ELSE '' END"""


@query("txt2_box_text", f"SELECT page_id, box_index, {BOX_SQL} AS box_text FROM (SELECT DISTINCT page_id, raw_text, b.box_index AS box_index, b.char_span AS s FROM (SELECT page_id, raw_text, unnest(page_boxes) AS b FROM page_content))")
def txt2_box_text(spark: SparkSession, sf: str) -> DataFrame:
    """TXT2: the text of each layout box."""
    boxes = table(spark, sf, "page_content").select("page_id", "raw_text", F.explode("page_boxes").alias("b")).select("page_id", "raw_text", F.col("b.box_index").alias("box_index"), F.col("b.char_span").alias("s")).distinct()
    return boxes.select("page_id", "box_index", T.box_text(F.col("raw_text"), F.col("s")).alias("box_text"))


LAYOUT_SQL = rf"""
WITH b AS (SELECT DISTINCT page_id, raw_text, page_boxes FROM page_content),
o AS (SELECT *, list_sort(list_transform(page_boxes, lambda b: {{'i': b.box_index, 'k': b.box_class, 's': b.char_span}}), 'ASC', 'NULLS FIRST') AS boxes FROM b),
s AS (SELECT *, list_filter(list_transform(boxes, lambda x: {{'k': coalesce(x.k, ''), 't': CASE WHEN raw_text IS NOT NULL AND len(x.s) = 2 AND x.s[1] >= 0 AND x.s[2] > x.s[1] AND x.s[1] < length(raw_text)
   THEN {_strip("substring(raw_text, x.s[1] + 1, least(x.s[2], length(raw_text)) - x.s[1])")} ELSE '' END}}), lambda x: x.t <> '' AND x.k NOT IN ('picture', 'page-header', 'page-footer')) AS slices FROM o),
j AS (SELECT *, coalesce(list_transform(list_filter(slices, lambda x: x.k = 'caption'), lambda x: x.t), []) AS captions,
  coalesce(list_reduce(list_concat([''], list_transform(list_filter(slices, lambda x: x.k <> 'caption'), lambda x: x.t)), lambda a, x: CASE WHEN a = '' THEN x WHEN ends_with(a, '-') AND regexp_matches(x, '^\p{{Ll}}') THEN left(a, -1) || x ELSE a || chr(10) || chr(10) || x END), '') AS joined FROM s)
SELECT DISTINCT page_id, CASE WHEN coalesce(len(page_boxes), 0) = 0 OR (length(joined) < 50 AND length({_strip("coalesce(raw_text, '')")}) > 200) THEN {_strip("coalesce(raw_text, '')")} ELSE joined END AS body, captions FROM j
"""


@query("txt4_layout_clean", LAYOUT_SQL)
def txt4_layout_clean(spark: SparkSession, sf: str) -> DataFrame:
    """TXT3, TXT4: body and captions of each page."""
    c = layout_clean(F.col("raw_text"), F.col("page_boxes"))
    return table(spark, sf, "page_content").select("page_id", c.alias("c")).select("page_id", "c.body", "c.captions").distinct()


@query("txt6_normalize", f"SELECT DISTINCT page_id, {_norm('raw_text')} AS clean FROM page_content")
def txt6_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """TXT6 on page texts."""
    return table(spark, sf, "page_content").select("page_id", T.normalize(F.col("raw_text")).alias("clean")).distinct()


@query("txt8_classify", f"SELECT section, {_heading_case('h')} AS kind, n FROM (SELECT section, coalesce({_heading('section')}, '') AS h, count(*) AS n FROM research_chunk GROUP BY section)")
def txt8_classify(spark: SparkSession, sf: str) -> DataFrame:
    """TXT5, TXT7, TXT8: the type of each section heading."""
    sections = table(spark, sf, "research_chunk").groupBy("section").agg(F.count("*").alias("n"))
    return sections.select("section", heading_type(F.col("section")).alias("kind"), "n")


META_SQL = " OR ".join(f"contains(lower(text), '{s}')" for s in T.METADATA_SIGNALS)


@query("txt9_metadata", f"SELECT source, count(*) AS n, count(*) FILTER (coalesce({META_SQL}, false)) AS marked, count(*) FILTER (coalesce(regexp_matches(text, '^\\P{{L}}*\\p{{Ll}}'), false)) AS low FROM documents GROUP BY source")
def txt9_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """TXT9, TXT10: texts with publisher's matter, and those that begin in lower case, by source."""
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(T.looks_like_metadata(F.col("text"))).alias("marked"), F.count_if(T.starts_with_lowercase(F.col("text"))).alias("low"))


@query("txt11_tokens", f"SELECT chunk_id, {_count('text')} AS tokens FROM (SELECT DISTINCT chunk_id, text FROM research_chunk)")
def txt11_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """TXT11: sizes of chunks in tokens of the default tokenizer."""
    return table(spark, sf, "research_chunk").select("chunk_id", "text").distinct().select("chunk_id", T.count_tokens(F.col("text")).alias("tokens"))


@query("txt13_terms", f"SELECT doc_id, {_terms('text')} AS terms, list_filter({_terms('text')}, lambda w: regexp_matches(w, '[0-9-]')) AS anchors FROM documents")
def txt13_terms(spark: SparkSession, sf: str) -> DataFrame:
    """TXT12-TXT14, AGG8: query terms and anchors of each text."""
    terms = T.query_terms(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", terms.alias("terms")).select("doc_id", "terms", T.anchor_terms(F.col("terms")).alias("anchors"))


@query("txt16_labels", "SELECT DISTINCT chunk_id, CASE WHEN page_start = page_end THEN page_start::varchar ELSE page_start || '-' || page_end END AS pages, '[' || filename || CASE WHEN page_start = page_end THEN ', p. ' || page_start ELSE ', pp. ' || page_start || '-' || page_end END || ']' AS label FROM research_chunk")
def txt16_labels(spark: SparkSession, sf: str) -> DataFrame:
    """TXT16, TXT17: page and citation labels."""
    a, b = F.col("page_start"), F.col("page_end")
    return table(spark, sf, "research_chunk").select("chunk_id", T.format_pages(a, b).alias("pages"), T.citation_label(F.col("filename"), a, b).alias("label")).distinct()


@query("txt22_paths", r"SELECT source_path, lower(replace(nfc_normalize(source_path), '\', '/')) AS path_key, count(*) AS n FROM parsed_document GROUP BY source_path")
def txt22_paths(spark: SparkSession, sf: str) -> DataFrame:
    """TXT22: path keys."""
    return table(spark, sf, "parsed_document").groupBy("source_path").agg(F.count("*").alias("n")).select("source_path", path_key(F.col("source_path")).alias("path_key"), "n")


@query("txt24_ids", "SELECT chunk_id, left(sha256(concat_ws('|', coalesce(source_sha256, ''), coalesce(page_start::varchar, ''), coalesce(section, ''), coalesce(text, ''))), 24) AS stable FROM (SELECT DISTINCT chunk_id, source_sha256, page_start, section, text FROM research_chunk)")
def txt24_ids(spark: SparkSession, sf: str) -> DataFrame:
    """TXT24: ids from content."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_sha256", "page_start", "section", "text")]
    return table(spark, sf, "research_chunk").select("chunk_id", "source_sha256", "page_start", "section", "text").distinct().select("chunk_id", T.stable_id(parts).alias("stable"))


@query("txt27_preview", f"SELECT evidence_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview, lower({_strip("coalesce(section, '')")}) AS label, CASE WHEN distance IS NULL OR isnan(distance) THEN 1.0 ELSE distance END AS d FROM (SELECT DISTINCT evidence_id, text, section, distance FROM evidence_item)")
def txt27_preview(spark: SparkSession, sf: str) -> DataFrame:
    """TXT25-TXT27: previews, labels and safe numbers."""
    e = table(spark, sf, "evidence_item").select("evidence_id", "text", "section", "distance").distinct()
    return e.select("evidence_id", T.preview(F.col("text"), 80).alias("preview"), T.normalize_label(F.col("section")).alias("label"), T.safe_double(F.col("distance"), 1.0).alias("d"))


SEARCH_SQL = ", ".join(f"'{s}'" for s in SEARCHABLE)
CAPTION_SQL = "(lower(trim(coalesce(chunk_type, ''))) = 'caption' OR " + " OR ".join(f"starts_with(lower({_strip("coalesce(section, '')")}), '{p}')" for p in ("figure ", "figure:", "fig. ", "fig ", "table ", "table:")) + ")"


@query("fil1_searchable", f"SELECT chunk_type, {CAPTION_SQL} AS caption_like, count(*) AS n FROM research_chunk WHERE chunk_type IN ({SEARCH_SQL}) GROUP BY ALL")
def fil1_searchable(spark: SparkSession, sf: str) -> DataFrame:
    """FIL1, FIL4: searched chunks by type and whether they are captions."""
    return table(spark, sf, "research_chunk").where(is_searchable(F.col("chunk_type"))).groupBy("chunk_type", T.caption_like(F.col("chunk_type"), F.col("section")).alias("caption_like")).agg(F.count("*").alias("n"))


# --- pages and chunks ---------------------------------------------------------------------------------------------
def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each page once, the row loaded last."""
    p = table(spark, sf, "page_content").where("page_id is not null and document_id is not null")
    one = p.groupBy("page_id").agg(F.max_by(F.struct("document_id", "page_number", "text", "raw_text", "captions", "metadata", "toc_items", "page_boxes"), F.struct("loaded_at", "raw_text")).alias("p"))
    return one.select("page_id", "p.*").withColumn("page_order", F.col("page_id"))


PAGES_SQL = "pages AS (SELECT * FROM page_content WHERE page_id IS NOT NULL AND document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC NULLS LAST, raw_text DESC NULLS LAST) = 1)"


@query("src3_page_numbers", f"WITH {PAGES_SQL} SELECT page_id, coalesce(try_cast(metadata['page_number'] AS integer), page_number) AS n FROM pages")
def src3_page_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """SRC3: printed page numbers where they are numbers."""
    return _pages(spark, sf).select("page_id", page_number(F.col("metadata"), F.col("page_number")).alias("n"))


@query("src3_titles", f"SELECT document_id, min(nullif({_strip('title')}, '')) AS title, min(nullif({_strip('author')}, '')) AS author, max(page_count) AS page_count FROM parsed_document GROUP BY document_id")
def src3_titles(spark: SparkSession, sf: str) -> DataFrame:
    """SRC3: of each document one title and author that isn't blank."""
    blank = F.lit("")
    d = table(spark, sf, "parsed_document")
    return d.groupBy("document_id").agg(F.min(F.nullif(T.strip(F.col("title")), blank)).alias("title"), F.min(F.nullif(T.strip(F.col("author")), blank)).alias("author"), F.max("page_count").alias("page_count"))


UNITS_SQL = rf"""
marked AS (SELECT page_id, regexp_replace(translate({_norm('text')}, chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(133) || chr(8232) || chr(8233), repeat(chr(10), 8)),
                  '(?m)^[ ]*(#{{1,6}})[ ]+(\S.*?)[ ]*$', chr(10) || chr(10) || chr(1) || '\1 \2' || chr(10) || chr(10), 'g') AS x FROM pages),
parts AS (SELECT page_id, unnest(list_filter(list_transform(regexp_split_to_array(x, '\n[ ]*\n\s*'), lambda p: trim(regexp_replace(p, '\s*\n\s*', ' ', 'g'))), lambda p: p <> '')) AS p FROM marked)
"""


@query("gen1_units", f"WITH {PAGES_SQL}, {UNITS_SQL} SELECT page_id, count(*) FILTER (starts_with(p, chr(1))) AS headings, count(*) FILTER (NOT starts_with(p, chr(1))) AS paragraphs, sum(length(p)) AS chars FROM parts GROUP BY page_id")
def gen1_units(spark: SparkSession, sf: str) -> DataFrame:
    """GEN1: headings and paragraphs of each page."""
    u = _pages(spark, sf).select("page_id", F.explode(markdown_units(F.col("text"))).alias("u")).select("page_id", "u.*")
    return u.groupBy("page_id").agg(F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "paragraph").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    d = src3_titles(spark, sf).select("document_id", "title")
    pages = _pages(spark, sf).join(d, "document_id", "left")
    return repair_interrupted(document_blocks(pages.select("document_id", "title", "page_order", "page_number", "text", "captions")))


# the tables have no headings: a page's blocks are its paragraphs and captions
BLOCKS_SQL = rf"""
WITH {PAGES_SQL}, {UNITS_SQL.replace("unnest(list_filter(list_transform(", "list_filter(list_transform(").replace("lambda p: p <> '')) AS p FROM marked", "lambda p: p <> '') AS ps FROM marked")},
t AS (SELECT document_id, min(nullif({_strip('title')}, '')) AS title FROM parsed_document GROUP BY document_id),
x AS (SELECT page_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS pos FROM parts),
f AS (SELECT x.*, document_id, page_number, coalesce({META_SQL}, false) AS meta, title FROM x JOIN (SELECT page_id, document_id, page_number FROM pages) USING (page_id) LEFT JOIN t USING (document_id)),
g AS (SELECT *, count(*) FILTER (meta) OVER (PARTITION BY page_id) >= greatest(2, count(*) OVER (PARTITION BY page_id) // 2) AS mostly FROM f),
c AS (SELECT document_id, page_id, page_number, unnest(captions) AS caption, generate_subscripts(captions, 1) - 1 AS i FROM pages)
SELECT document_id, page_id AS page_order, pos, text, page_number, coalesce(title, 'Main text') AS section, CASE WHEN mostly OR meta THEN 'metadata' ELSE 'body' END AS chunk_type, false AS is_heading, CAST(NULL AS integer) AS level FROM g
UNION ALL SELECT document_id, page_id, i + 1048576, {_norm('caption')}, page_number, 'Figure / Table Caption', 'caption', false, NULL FROM c WHERE {_norm('caption')} <> ''
"""


@query("gen2_blocks", BLOCKS_SQL)
def gen2_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """GEN2, GEN3, GEN5, FIL6: blocks of all documents with section and type."""
    return _blocks(spark, sf)


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "parsed_document").groupBy("document_id").agg(F.max("sha256").alias("sha256"))
    segs = segments(_blocks(spark, sf))
    named = table(spark, sf, "page_content").select("document_id").where("document_id is not null").distinct().join(docs, "document_id", "left")
    return assemble_chunks(segs, named)


SPLIT_SQL = rf"""
WITH RECURSIVE c AS (SELECT DISTINCT chunk_id, {_strip('text')} AS t FROM research_chunk WHERE text IS NOT NULL),
n AS (SELECT chunk_id, t, {_count('t')} AS n FROM c),
sents AS (SELECT chunk_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z0-9(\[])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda s: {_strip('s')}), lambda s: s <> '') AS ss FROM n WHERE n > 700),
sized AS (SELECT chunk_id, unnest(list_transform(ss, lambda s: {_count('s')})) AS n, generate_subscripts(ss, 1) AS i FROM sents WHERE len(ss) > 1),
walk AS (
  SELECT chunk_id, 0::bigint AS i, 0::bigint AS cur, 0::bigint AS pieces FROM sized GROUP BY chunk_id
  UNION ALL
  SELECT w.chunk_id, s.i,
    CASE WHEN (w.cur = 0 OR w.cur + s.n > 550) AND s.n > 700 THEN 0 WHEN w.cur = 0 OR w.cur + s.n > 550 THEN s.n ELSE w.cur + s.n END,
    w.pieces + CASE WHEN w.cur > 0 AND w.cur + s.n > 550 THEN 1 ELSE 0 END + CASE WHEN (w.cur = 0 OR w.cur + s.n > 550) AND s.n > 700 THEN 1 + (s.n - 101) // 450 ELSE 0 END
  FROM walk w JOIN sized s ON s.chunk_id = w.chunk_id AND s.i = w.i + 1),
packed AS (SELECT chunk_id, arg_max(pieces + CASE WHEN cur > 0 THEN 1 ELSE 0 END, i) AS pieces FROM walk GROUP BY chunk_id)
SELECT chunk_id, CASE WHEN n <= 700 THEN 1 WHEN packed.pieces IS NULL THEN 1 + (n - 101) // 450 ELSE packed.pieces END AS pieces FROM n LEFT JOIN packed USING (chunk_id)
"""


@query("gen6_split", SPLIT_SQL)
def gen6_split(spark: SparkSession, sf: str) -> DataFrame:
    """GEN6: into how many segments each stored chunk would be cut."""
    c = table(spark, sf, "research_chunk").select("chunk_id", "text").distinct().where("text is not null")
    return c.select("chunk_id", F.size(split_long(F.col("text"))).alias("pieces"))


@query("gen10_chunks")
def gen10_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """GEN6-GEN12: chunks of all documents."""
    return _chunks(spark, sf)


@query("agg2_chunk_stats", "SELECT count(*) AS chunks, coalesce(sum(token_count), 0) AS tokens, coalesce(min(token_count), 0) AS least, coalesce(max(token_count), 0) AS most, round(coalesce(avg(token_count), 0), 4) AS mean, count(*) FILTER (token_count < 180) AS below, count(*) FILTER (token_count > 700) AS above FROM research_chunk")
def agg2_chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AGG2 on the stored chunks."""
    return chunk_statistics(table(spark, sf, "research_chunk"))


@query("agg2_chunk_types", "SELECT chunk_type, count(*) AS n FROM research_chunk GROUP BY chunk_type")
def agg2_chunk_types(spark: SparkSession, sf: str) -> DataFrame:
    """AGG2: chunks by type."""
    return table(spark, sf, "research_chunk").groupBy("chunk_type").agg(F.count("*").alias("n"))


@query(
    "agg1_doc_stats",
    f"WITH {PAGES_SQL} SELECT document_id, count(*) AS pages, sum(length(coalesce(text, ''))) AS chars, sum(length(coalesce(raw_text, ''))) AS raw_chars, count(*) FILTER ({_strip("coalesce(text, '')")} = '') AS empty_pages, count(*) FILTER (coalesce(len(toc_items), 0) > 0) AS pages_with_toc, count(*) FILTER (coalesce(len(page_boxes), 0) > 0) AS pages_with_layout, sum(coalesce(len(captions), 0)) AS captions FROM pages GROUP BY document_id",
)
def agg1_doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AGG1: extraction statistics of each document."""
    return document_statistics(_pages(spark, sf))


@query("src11_markdown", f"""WITH {PAGES_SQL}, d AS (SELECT * FROM parsed_document QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY loaded_at DESC NULLS LAST, filename DESC NULLS LAST, source_path DESC NULLS LAST, sha256 DESC NULLS LAST, title DESC NULLS LAST, author DESC NULLS LAST) = 1)
SELECT document_id, -1 AS page_order, concat_ws(chr(10), '# ' || coalesce(filename, ''), 'Source: ' || source_path, 'SHA-256: ' || sha256, CASE WHEN {_strip('title')} <> '' THEN 'Title: ' || title END, CASE WHEN {_strip('author')} <> '' THEN 'Author: ' || author END) AS part FROM d
UNION ALL SELECT document_id, page_id, concat_ws(chr(10) || chr(10), '<!-- page ' || coalesce(page_number::varchar, '?') || ' -->', coalesce(text, ''), CASE WHEN len(captions) > 0 THEN 'Captions:' || chr(10) || array_to_string(list_transform(captions, lambda c: '- ' || c), chr(10)) END) FROM pages""")
def src11_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """SRC11: all documents as Markdown."""
    d = table(spark, sf, "parsed_document").groupBy("document_id").agg(F.max(F.struct("loaded_at", "filename", "source_path", "sha256", "title", "author")).alias("d")).select("document_id", "d.*")
    return markdown_export(d, _pages(spark, sf))


@query("src14_chunk_report")
def src14_chunk_report(spark: SparkSession, sf: str) -> DataFrame:
    """SRC14: a report of all chunks."""
    return chunk_report(_chunks(spark, sf))


# --- vectors and retrieval ----------------------------------------------------------------------------------------
@query("vec1_normalize", "SELECT vec_id, list_transform(embedding, lambda x: round(x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))), 6)) AS unit FROM embeddings")
def vec1_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """VEC1: vectors of unit length."""
    return table(spark, sf, "embeddings").select("vec_id", F.transform(l2_normalize(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


@query("vec7_dimensions", "SELECT coalesce(len(vector), -1) AS dimension, count(*) AS n FROM research_chunk GROUP BY 1")
def vec7_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """VEC7: stored vectors by dimension."""
    return dimensions(table(spark, sf, "research_chunk"), "vector")


@query(
    "agg7_pooled",
    "WITH flat AS (SELECT label, i, (embedding[i])::double AS x, 1 + vec_id % 3 AS w FROM embeddings, range(1, 65) t(i)), mean AS (SELECT label, i, sum(w * x) / sum(w) AS x FROM flat GROUP BY ALL), norm AS (SELECT label, sqrt(sum(x * x)) AS n FROM mean GROUP BY label) SELECT label, list(round(x / n, 6) ORDER BY i) AS pooled FROM mean JOIN norm USING (label) GROUP BY label",
)
def agg7_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """AGG7: weighted means of vectors by label."""
    p = pooled(table(spark, sf, "embeddings"), "label", "embedding", 1 + F.col("vec_id") % 3)
    return p.select("label", F.transform("pooled", lambda x: F.round(x, 6)).alias("pooled"))


@query("vec8_similarity", "SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i])::double * (b.embedding[i])::double)), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec8_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """VEC8: inner products of neighbouring rows."""
    e = table(spark, sf, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.round(dot(F.col("embedding"), F.col("other")), 6).alias("dot"))


KNN_SQL = """
SELECT q.vec_id AS query_id, r.vec_id AS row_id, round(list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i])::double - (r.embedding[i])::double) ** 2)), 9) AS distance
FROM embeddings q JOIN embeddings r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id
"""


def _knn(spark: SparkSession, sf: str, k: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return nearest_neighbours(e, e.where("vec_id % 100 = 0"), "vec_id", "vec_id", "embedding", k, dim=64, exclude_self=True)


@query("ret1_knn", f"SELECT query_id, row_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM ({KNN_SQL})) WHERE rank <= 10")
def ret1_knn(spark: SparkSession, sf: str) -> DataFrame:
    """RET1: of every vector whose id is divisible by 100 the ten nearest, against all."""
    return _knn(spark, sf, 10).withColumn("distance", F.round("distance", 6))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """First sentences of the documents whose id is divisible by 100."""
    d = table(spark, sf, "documents").where("doc_id % 100 = 0 and text is not null")
    return d.select(F.col("doc_id").alias("query_id"), F.regexp_extract("text", r"^\s*([^.!?\n]*)", 1).alias("question"))


WORDS_SQL = "list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]*'), lambda w: lower(w))"
BM25_SQL = rf"""
words AS (SELECT doc_id AS id, {WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
full_ AS (SELECT id, w, len(w) AS dl FROM words WHERE len(w) > 0),
stats AS (SELECT count(*)::double AS n, avg(dl) AS mean FROM full_),
post AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, dl, unnest(w) AS term FROM full_) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
ques AS (SELECT doc_id AS query_id, {_terms(r"regexp_extract(text, '^\s*([^.!?\n]*)', 1)")} AS terms FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL),
qt AS (SELECT query_id, unnest(terms) AS term FROM ques),
sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score FROM qt JOIN post USING (term) JOIN dfs USING (term), stats GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)
"""


@query("ret2_bm25", f"WITH {BM25_SQL} SELECT query_id, id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10")
def ret2_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """RET2, SRC17: the ten best documents for each question, against all."""
    index, stats = build_index(table(spark, sf, "documents"), "doc_id", F.col("text"), unique=True)
    return bm25(index, stats, _questions(spark, sf), 10).withColumn("score", F.round("score", 6))


@query("src17_postings", f"SELECT term, count(*) AS texts, sum(tf) AS occurrences FROM (SELECT term, id, count(*) AS tf FROM (SELECT doc_id AS id, unnest({WORDS_SQL}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def src17_postings(spark: SparkSession, sf: str) -> DataFrame:
    """SRC17: how many texts each word stands in."""
    return postings(table(spark, sf, "documents"), "doc_id", F.col("text"), unique=True).groupBy("term").agg(F.count("*").alias("texts"), F.sum("tf").alias("occurrences"))


RRF_SQL = f"""
WITH {BM25_SQL}, knn AS (SELECT query_id, row_id AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM ({KNN_SQL})) WHERE rank <= 36),
both_ AS (SELECT query_id, id, 1.0 / (60 + rank) AS part FROM bm WHERE rank <= 36 UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM knn),
fused AS (SELECT query_id, id, round(sum(part), 12) AS score FROM both_ GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused)
"""


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    index, stats = build_index(table(spark, sf, "documents"), "doc_id", F.col("text"), unique=True)
    lexical = bm25(index, stats, _questions(spark, sf), 36).select("query_id", "id", "rank")
    return fuse([lexical, _knn(spark, sf, 36).select("query_id", F.col("row_id").alias("id"), "rank")], 36)


@query("ret3_rrf", RRF_SQL + "SELECT query_id, id, round(score, 9) AS score, rank FROM ranked WHERE rank <= 36")
def ret3_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """RET3, JON7: both rankings fused. The tables of vectors and texts share no key; a vector stands for the document of its number."""
    return _fused(spark, sf).withColumn("score", F.round("score", 9))


TYPES_SQL = "CASE doc_id % 6 WHEN 0 THEN 'caption' WHEN 1 THEN 'methods' WHEN 2 THEN 'supplementary' WHEN 3 THEN 'results' WHEN 4 THEN 'body' ELSE 'caption' END"


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a type by their number: the table has none."""
    m = F.col("doc_id") % 6
    kind = F.when(m.isin(0, 5), "caption").when(m == 1, "methods").when(m == 2, "supplementary").when(m == 3, "results").otherwise("body")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), kind.alias("chunk_type"), F.lit("").alias("section"))


REFINE_SQL = RRF_SQL.rstrip() + f""",
cand AS (SELECT r.*, chunk_type, score * CASE chunk_type WHEN 'caption' THEN 0.8 WHEN 'methods' THEN 0.97 WHEN 'supplementary' THEN 0.92 ELSE 1.0 END AS refined FROM ranked r JOIN (SELECT doc_id AS id, {TYPES_SQL} AS chunk_type FROM documents) USING (id) WHERE rank <= 36),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY refined DESC, score DESC, rank) AS ord FROM cand),
c AS (SELECT *, chunk_type = 'caption' AND count(*) FILTER (chunk_type = 'caption') OVER (PARTITION BY query_id ORDER BY ord) > 2 AS deferred FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY deferred, ord) AS pick FROM c)
SELECT query_id, id, chunk_type, round(refined, 9) AS refined, row_number() OVER (PARTITION BY query_id ORDER BY refined DESC, score DESC, deferred, ord) AS final_rank FROM p WHERE pick <= 12
"""


@query("ret6_refine", REFINE_SQL)
def ret6_refine(spark: SparkSession, sf: str) -> DataFrame:
    """RET4-RET7: fused candidates weighted by type, with a quota for captions."""
    r = refine(_fused(spark, sf).join(_typed(spark, sf), "id"), 12)
    return r.select("query_id", "id", "chunk_type", F.round("refined", 9).alias("refined"), "final_rank")


def _refined(source: str, name: str) -> str:
    return f"""{name}_c AS (SELECT r.*, chunk_type, score * CASE chunk_type WHEN 'caption' THEN 0.8 WHEN 'methods' THEN 0.97 WHEN 'supplementary' THEN 0.92 ELSE 1.0 END AS refined FROM {source} r JOIN (SELECT doc_id AS id, {TYPES_SQL} AS chunk_type FROM documents) USING (id) WHERE rank <= 36),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY refined DESC, score DESC, rank) AS ord FROM {name}_c),
{name}_d AS (SELECT *, chunk_type = 'caption' AND count(*) FILTER (chunk_type = 'caption') OVER (PARTITION BY query_id ORDER BY ord) > 2 AS deferred FROM {name}_o),
{name}_p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY deferred, ord) AS pick FROM {name}_d),
{name} AS (SELECT '{name}' AS label, query_id, row_number() OVER (PARTITION BY query_id ORDER BY refined DESC, score DESC, deferred, ord) AS rank, id FROM {name}_p WHERE pick <= 12)"""


@query("ret8_retrieve", RRF_SQL.rstrip() + f", near AS (SELECT query_id, id, 1.0 / (60 + rank) AS score, rank FROM knn), {_refined('ranked', 'hybrid')}, {_refined('near', 'vector')} SELECT * FROM hybrid UNION ALL SELECT * FROM vector")
def ret8_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """RET7-RET9: candidates of each question in both modes, below one another."""
    index, stats = build_index(table(spark, sf, "documents"), "doc_id", F.col("text"), unique=True)
    q, types = _questions(spark, sf), _typed(spark, sf)
    near = _knn(spark, sf, 36).select("query_id", F.col("row_id").alias("id"), "rank")
    one = lambda df: df.select("query_id", F.col("final_rank").alias("rank"), "id")
    return comparison({m: one(retrieve(index, stats, q, types, near, 12, mode=m)) for m in ("vector", "hybrid")})


@query("vec3_embed")
def vec3_embed(spark: SparkSession, sf: str) -> DataFrame:
    """VEC3-VEC6, GEN15: vectors of all chunks by the stand-in embedder, long texts split and pooled."""
    c = table(spark, sf, "research_chunk").where(is_searchable(F.col("chunk_type"))).select("chunk_id", "text").distinct()
    return embed_column(c, "text", "vector", HashingEmbedder(64, 4000)).select("chunk_id", "vector")


# --- evidence and answers -----------------------------------------------------------------------------------------
EVID_SQL = "ev AS (SELECT * FROM (SELECT DISTINCT query_id, source_id, chunk_id, filename, title, author, page_start, page_end, section, chunk_type, text FROM evidence_item WHERE query_id IS NOT NULL AND source_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY chunk_id DESC NULLS LAST, text DESC NULLS LAST) = 1)"


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Each source of a query once."""
    e = table(spark, sf, "evidence_item").where("query_id is not null and source_id is not null")
    cols = ["chunk_id", "text", "filename", "title", "author", "page_start", "page_end", "section", "chunk_type"]
    return e.groupBy("query_id", "source_id").agg(F.max(F.struct(*cols)).alias("e")).select("query_id", "source_id", "e.*")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).withColumn("rank", F.substring("source_id", 2, 9).cast("int")).drop("source_id")


EVD1_SQL = f"""
{EVID_SQL}, cand AS (SELECT *, substring(source_id, 2)::int AS rank FROM ev WHERE chunk_id IS NOT NULL AND {_strip('chunk_id')} <> '' QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, text) = 1),
pieces AS (SELECT query_id, chunk_id, rank, pos, {_strip('p')} AS p FROM (SELECT query_id, chunk_id, rank, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS p, generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n'), 1) AS pos FROM cand) WHERE {_strip('p')} <> ''),
normed AS (SELECT *, lower(trim(regexp_replace(translate(p, {BLANK_SQL}, repeat(' ', 28)), ' +', ' ', 'g'))) AS norm FROM pieces),
kept AS (SELECT * FROM normed WHERE length(norm) < 120 UNION ALL SELECT * FROM normed WHERE length(norm) >= 120 QUALIFY row_number() OVER (PARTITION BY query_id, norm ORDER BY rank, chunk_id, pos) = 1),
texts AS (SELECT query_id, chunk_id, min(rank) AS rank, string_agg(p, chr(10) || chr(10) ORDER BY pos) AS text FROM kept GROUP BY ALL)
"""


@query("evd1_paragraph_dedup", f"WITH {EVD1_SQL} SELECT query_id, chunk_id, text FROM texts")
def evd1_paragraph_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """EVD1, FIL5: evidence without paragraphs seen before."""
    return without_repeats(_candidates(spark, sf)).select("query_id", "chunk_id", "text")


EVD2_SQL = f"""
WITH RECURSIVE {EVD1_SQL}, sized AS (SELECT query_id, chunk_id, rank, {_count('text')} AS n FROM texts),
ok AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS i FROM sized WHERE n >= 20 AND rank <= 36),
walk AS (
  SELECT query_id, 0::bigint AS i, 0::bigint AS used, 0::bigint AS kept, NULL::varchar AS chunk_id, false AS take FROM ok GROUP BY query_id
  UNION ALL
  SELECT w.query_id, o.i, CASE WHEN w.kept < 8 AND w.used + o.n <= 2000 THEN w.used + o.n ELSE w.used END, CASE WHEN w.kept < 8 AND w.used + o.n <= 2000 THEN w.kept + 1 ELSE w.kept END, o.chunk_id, w.kept < 8 AND w.used + o.n <= 2000
  FROM walk w JOIN ok o ON o.query_id = w.query_id AND o.i = w.i + 1)
SELECT query_id, 'S' || kept AS source_id, walk.chunk_id, n AS token_count FROM walk JOIN sized USING (query_id, chunk_id) WHERE take
"""


@query("evd2_budget_select", EVD2_SQL)
def evd2_budget_select(spark: SparkSession, sf: str) -> DataFrame:
    """EVD2, EVD3: at most eight pieces of evidence within 2,000 tokens."""
    return select_evidence(_candidates(spark, sf), 8, 2000, pool=36).select("query_id", "source_id", "chunk_id", "token_count")


@query(
    "agg9_context",
    f"""WITH {EVID_SQL}, blocks AS (SELECT query_id, substring(source_id, 2, 9)::int AS n, source_id, {_count('text')} AS t,
 concat_ws(chr(10), '[' || source_id || ']', 'File: ' || coalesce(filename, ''), 'Page(s): ' || coalesce(CASE WHEN page_start = page_end THEN page_start::varchar ELSE page_start || '-' || page_end END, ''), 'Section: ' || coalesce(section, ''), 'Type: ' || coalesce(chunk_type, ''), CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN author <> '' THEN 'Author: ' || author END) || chr(10) || chr(10) || coalesce(text, '') AS block FROM ev)
SELECT query_id, string_agg(block, chr(10) || chr(10) || repeat('=', 72) || chr(10) || chr(10) ORDER BY n, source_id) AS context, sum(t) AS tokens FROM blocks GROUP BY query_id""",
)
def agg9_context(spark: SparkSession, sf: str) -> DataFrame:
    """AGG9, AGG5: the evidence of each query as one text."""
    return evidence_context(_evidence(spark, sf).withColumn("token_count", T.count_tokens(F.col("text"))))


ASKED_SQL = "asked AS (SELECT query_id, regexp_extract(max(text), '^\\s*([^.!?\\n]*)', 1) || CASE WHEN query_id % 3 = 0 THEN ' with XQZ-99' ELSE '' END AS question FROM ev GROUP BY query_id)"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """A question on each query's evidence; every third names something that isn't there."""
    q = _evidence(spark, sf).groupBy("query_id").agg(F.regexp_extract(F.max("text"), r"^\s*([^.!?\n]*)", 1).alias("q"))
    return q.select("query_id", F.concat("q", F.when(F.col("query_id") % 3 == 0, " with XQZ-99").otherwise("")).alias("question"))


@query(
    "gat1_lexical_gate",
    f"""WITH {EVID_SQL}, {ASKED_SQL}, q AS (SELECT query_id, {_terms('question')} AS terms FROM asked),
w AS (SELECT query_id, list_distinct(flatten(list({WORDS_SQL.replace('text', "coalesce(text, '')")}))) AS words FROM ev GROUP BY query_id),
m AS (SELECT query_id, terms, list_filter(terms, lambda t: list_contains(words, t)) AS matched, list_filter(terms, lambda t: regexp_matches(t, '[0-9-]')) AS anchors FROM q JOIN w USING (query_id))
SELECT query_id, NOT (len(anchors) > 0 AND len(list_intersect(anchors, matched)) = 0) AND NOT (len(terms) > 0 AND len(matched) = 0) AS sufficient,
 CASE WHEN len(anchors) > 0 AND len(list_intersect(anchors, matched)) = 0 THEN 'no distinctive term found' WHEN len(terms) > 0 AND len(matched) = 0 THEN 'no term found' ELSE 'terms found' END AS reason, terms, anchors, matched FROM m WHERE terms IS NOT NULL""",
)
def gat1_lexical_gate(spark: SparkSession, sf: str) -> DataFrame:
    """GAT1, JON5: whether the evidence has the words of the question."""
    return lexical_gate(_asked(spark, sf), _evidence(spark, sf)).where("terms is not null")


ANSWER_SQL = r"answers AS (SELECT query_id, string_agg(coalesce(regexp_extract(text, '^\s*([^.!?\n]*)', 1), '') || ' [' || CASE WHEN query_id % 5 = 0 AND source_id = 'S1' THEN 'S99' ELSE source_id END || '].', chr(10) || chr(10) ORDER BY substring(source_id, 2)::int) AS answer FROM ev GROUP BY query_id)"


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer from the first sentences of each query's evidence; every fifth cites what isn't there."""
    mark = F.when((F.col("query_id") % 5 == 0) & (F.col("source_id") == "S1"), "S99").otherwise(F.col("source_id"))
    part = F.concat(F.coalesce(F.regexp_extract("text", r"^\s*([^.!?\n]*)", 1), F.lit("")), F.lit(" ["), mark, F.lit("]."))
    e = _evidence(spark, sf).select("query_id", F.substring("source_id", 2, 9).cast("int").alias("n"), part.alias("p"))
    return e.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda s: s["p"]), "\n\n").alias("answer"))


# one claim a piece of evidence, numbered in order, with what it cites and its verdict
CLAIM_SQL = r"""claims AS (SELECT query_id, n, s, mark, row_number() OVER (PARTITION BY query_id ORDER BY n) AS k FROM (SELECT query_id, substring(source_id, 2)::int AS n, coalesce(regexp_extract(text, '^\s*([^.!?\n]*)', 1), '') AS s, CASE WHEN query_id % 5 = 0 AND source_id = 'S1' THEN 'S99' ELSE source_id END AS mark FROM ev)),
verdicts AS (SELECT *, CASE WHEN (query_id + k) % 4 = 0 THEN 2 WHEN query_id % 7 = 1 THEN 1 ELSE 0 END AS v FROM claims)"""
CITED_SQL = r"list_transform(regexp_extract_all(answer, '\[S(\d+)\]', 1), lambda n: 'S' || n)"


@query(
    "cit1_verify",
    f"WITH {EVID_SQL}, {ANSWER_SQL}, c AS (SELECT query_id, list_filter({CITED_SQL}, lambda x, i: list_position({CITED_SQL}, x) = i) AS cited FROM answers), k AS (SELECT query_id, list(source_id) AS known FROM ev GROUP BY query_id), u AS (SELECT query_id, cited, list_filter(cited, lambda x: NOT list_contains(known, x)) AS unknown FROM c JOIN k USING (query_id)) SELECT *, len(cited) > 0 AS has_citations, len(cited) > 0 AND len(unknown) = 0 AS valid FROM u",
)
def cit1_verify(spark: SparkSession, sf: str) -> DataFrame:
    """CIT1, TXT19, JON4: what each answer cites, and what of it isn't there."""
    return verify_citations(_answers(spark, sf), _evidence(spark, sf))


@query("cit3_render", f"WITH {EVID_SQL}, {CLAIM_SQL} SELECT c.query_id, string_agg(s || ' ' || coalesce(\'[\' || filename || CASE WHEN page_start = page_end THEN \', p. \' || page_start ELSE \', pp. \' || page_start || \'-\' || page_end END || \']\', '[' || mark || ']') || '.', chr(10) || chr(10) ORDER BY n) AS rendered FROM claims c LEFT JOIN ev ON ev.query_id = c.query_id AND ev.source_id = c.mark GROUP BY c.query_id")
def cit3_render(spark: SparkSession, sf: str) -> DataFrame:
    """CIT3, TXT17, JON3: answers with file and pages for their marks."""
    return render_citations(_answers(spark, sf), _evidence(spark, sf))


@query("gen14_claims", f"""WITH {EVID_SQL}, {ANSWER_SQL}, p AS (SELECT query_id, unnest(regexp_split_to_array(answer, '\\n\\s*\\n')) AS p, generate_subscripts(regexp_split_to_array(answer, '\\n\\s*\\n'), 1) AS i FROM answers),
 c AS (SELECT query_id, i, trim(regexp_replace(regexp_replace(p, '\\[S(\\d+)\\]', '', 'g'), '\\s+', ' ', 'g'), ' -•' || chr(9) || chr(10)) AS claim FROM p)
 SELECT query_id, 'C' || row_number() OVER (PARTITION BY query_id ORDER BY i) AS claim_id, claim FROM c WHERE claim <> ''""")
def gen14_claims(spark: SparkSession, sf: str) -> DataFrame:
    """GEN13, GEN14, TXT18-TXT20: cited claims of each answer."""
    return claims(_answers(spark, sf)).where("claim_id is not null").select("query_id", "claim_id", "claim")


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts in place of a model's: by the number of the claim."""
    c = claims(_answers(spark, sf)).where("claim_id is not null").select("query_id", "claim_id", F.substring("claim_id", 2, 9).cast("int").alias("n"))
    return c.select("query_id", "claim_id", F.when((F.col("query_id") + F.col("n")) % 4 == 0, "UNSUPPORTED").when(F.col("query_id") % 7 == 1, "PARTIAL").otherwise("SUPPORTED").alias("verdict"))


@query("clm2_prompts", rf"WITH {EVID_SQL}, {CLAIM_SQL} SELECT c.query_id, 'C' || k AS claim_id, 'Claim: ' || trim(regexp_replace(s || ' .', '\s+', ' ', 'g'), ' -•' || chr(9) || chr(10)) || chr(10) || chr(10) || 'Evidence:' || chr(10) || '[' || mark || ']' || chr(10) || coalesce(text, 'SOURCE NOT FOUND') AS prompt, (k - 1) // 2 AS batch FROM claims c LEFT JOIN ev ON ev.query_id = c.query_id AND ev.source_id = c.mark")
def clm2_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """CLM2, CLM3: each claim with the evidence it cites, and the call it goes into."""
    c = claims(_answers(spark, sf))
    return claim_prompts(c, _evidence(spark, sf)).join(verification_batches(c), ["query_id", "claim_id"])


@query("clm3_support", f"WITH {EVID_SQL}, {CLAIM_SQL} SELECT query_id, count(*) AS claims, count(*) FILTER (v = 0) AS supported, count(*) FILTER (v = 1) AS partial, count(*) FILTER (v = 2) AS unsupported, 0 AS uncited, []::varchar[] AS missing, []::varchar[] AS unknown, count(*) <= 24 AND count(*) FILTER (v = 0) = count(*) AS valid FROM verdicts GROUP BY query_id")
def clm3_support(spark: SparkSession, sf: str) -> DataFrame:
    """CLM3, CLM4, AGG4, JON6: whether all claims of an answer are supported."""
    return support_check(_answers(spark, sf), _verdicts(spark, sf))


@query("clm5_prune", f"WITH {EVID_SQL}, {CLAIM_SQL} SELECT query_id, coalesce(string_agg({_strip("s || ' [' || mark || '].'")}, chr(10) || chr(10) ORDER BY n) FILTER (v = 0), '') AS answer FROM verdicts GROUP BY query_id")
def clm5_prune(spark: SparkSession, sf: str) -> DataFrame:
    """CLM5: what is left of each answer."""
    return prune(_answers(spark, sf), _verdicts(spark, sf))


@query("clm6_renumber", f"WITH {EVID_SQL}, {CLAIM_SQL} SELECT query_id, 'C' || k AS old_id, 'C' || row_number() OVER (PARTITION BY query_id ORDER BY k) AS claim_id FROM verdicts WHERE v = 0")
def clm6_renumber(spark: SparkSession, sf: str) -> DataFrame:
    """CLM6: supported claims numbered anew."""
    return renumbered(claims(_answers(spark, sf)), _verdicts(spark, sf))


# the gate as in gat1, the answers as in cit3, the verdicts as in clm3
OUTCOME_SQL = f"""
WITH {EVID_SQL}, {ASKED_SQL}, {CLAIM_SQL}, q AS (SELECT query_id, {_terms('question')} AS terms FROM asked),
w AS (SELECT query_id, list_distinct(flatten(list({WORDS_SQL.replace('text', "coalesce(text, '')")}))) AS words FROM ev GROUP BY query_id),
m AS (SELECT query_id, terms, list_filter(terms, lambda t: list_contains(words, t)) AS matched, list_filter(terms, lambda t: regexp_matches(t, '[0-9-]')) AS anchors FROM q JOIN w USING (query_id)),
gate AS (SELECT query_id, NOT (len(anchors) > 0 AND len(list_intersect(anchors, matched)) = 0) AND NOT (len(terms) > 0 AND len(matched) = 0) AS ok FROM m),
a AS (SELECT v.query_id, bool_and(ev.source_id IS NOT NULL) AS cited, count(*) <= 24 AND bool_and(v = 0) AS supported, coalesce(bool_or(v = 0), false) AS any_kept,
  string_agg(s || ' ' || coalesce('[' || filename || CASE WHEN page_start = page_end THEN ', p. ' || page_start ELSE ', pp. ' || page_start || '-' || page_end END || ']', '[' || mark || ']') || '.', chr(10) || chr(10) ORDER BY n) AS whole,
  string_agg(ltrim(s, {BLANK_SQL}) || ' ' || coalesce('[' || filename || CASE WHEN page_start = page_end THEN ', p. ' || page_start ELSE ', pp. ' || page_start || '-' || page_end END || ']', '[' || mark || ']') || '.', chr(10) || chr(10) ORDER BY n) FILTER (v = 0) AS part
  FROM verdicts v LEFT JOIN ev ON ev.query_id = v.query_id AND ev.source_id = v.mark GROUP BY v.query_id),
o AS (SELECT query_id, CASE WHEN NOT coalesce(ok, false) THEN 'insufficient evidence' WHEN query_id % 11 = 0 THEN 'not generated' WHEN NOT cited THEN 'citations invalid' WHEN supported THEN 'answered' WHEN any_kept THEN 'answered in part' ELSE 'claims not supported' END AS outcome, whole, part FROM a LEFT JOIN gate USING (query_id))
SELECT query_id, outcome, CASE outcome WHEN 'answered' THEN whole WHEN 'answered in part' THEN part END AS answer FROM o
"""


@query("qa1_outcomes", OUTCOME_SQL)
def qa1_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """QA1, QA2, GEN21: where the way of each question ends."""
    e, asked = _evidence(spark, sf), _asked(spark, sf)
    a = _answers(spark, sf).withColumn("done_reason", F.when(F.col("query_id") % 11 == 0, "length").otherwise("stop"))
    return outcomes(asked, e, lexical_gate(asked, e), a, _verdicts(spark, sf))


# --- index and sync -----------------------------------------------------------------------------------------------
STATE_SQL = f"""
state AS (SELECT lower(source_path) AS normalized_path, list_sort(list_distinct(list(source_path))) AS source_paths,
 list_sort(list_distinct(coalesce(list(nullif(lower({_strip('source_sha256')}), '')) FILTER (nullif(lower({_strip('source_sha256')}), '') IS NOT NULL), []))) AS sha256s, count(*) AS row_count
 FROM research_chunk WHERE source_path IS NOT NULL GROUP BY 1)
"""


@query("agg3_doc_state", f"WITH {STATE_SQL} SELECT * FROM state")
def agg3_doc_state(spark: SparkSession, sf: str) -> DataFrame:
    """AGG3, SRC6: what the index holds of each path."""
    return document_state(table(spark, sf, "research_chunk"))


def _library(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "parsed_document").select(F.col("source_path").alias("path"), F.lower("source_path").alias("normalized_path"), "sha256")


@query(
    "jon1_sync_plan",
    f"""WITH {STATE_SQL}, lib AS (SELECT lower(source_path) AS normalized_path, source_path AS path, lower(sha256) AS sha256 FROM parsed_document WHERE source_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(source_path) ORDER BY source_path DESC, lower(sha256) DESC) = 1)
SELECT coalesce(l.normalized_path, s.normalized_path) AS normalized_path, path, sha256, CASE WHEN s.normalized_path IS NULL THEN 'NEW' WHEN l.normalized_path IS NULL THEN 'DELETED' WHEN len(sha256s) = 1 AND sha256s[1] = sha256 THEN 'UNCHANGED' ELSE 'CHANGED' END AS status
FROM lib l FULL JOIN state s ON l.normalized_path = s.normalized_path""",
)
def jon1_sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    """JON1: what is new, changed, unchanged or deleted in the library."""
    return sync_plan(_library(spark, sf), document_state(table(spark, sf, "research_chunk")))


INDEX_SQL = "idx AS (SELECT chunk_id, source_path, text, token_count FROM research_chunk), scope AS (SELECT DISTINCT source_path FROM parsed_document WHERE page_count % 2 = 0), fresh AS (SELECT DISTINCT chunk_id || 'n' AS chunk_id, source_path, upper(text) AS text, token_count FROM research_chunk WHERE source_path IN (SELECT source_path FROM scope) UNION ALL SELECT DISTINCT evidence_id, filename, text, token_count FROM evidence_item)"


def _index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    idx = table(spark, sf, "research_chunk").select("chunk_id", "source_path", "text", "token_count")
    scope = table(spark, sf, "parsed_document").where("page_count % 2 = 0").select("source_path").distinct()
    anew = idx.join(scope, "source_path", "left_semi").select(F.concat("chunk_id", F.lit("n")).alias("chunk_id"), "source_path", F.upper("text").alias("text"), "token_count").distinct()
    added = table(spark, sf, "evidence_item").select(F.col("evidence_id").alias("chunk_id"), F.col("filename").alias("source_path"), "text", "token_count").distinct()
    return idx, scope, anew.unionByName(added)


@query("src8_merge", f"WITH {INDEX_SQL} SELECT * FROM idx WHERE (source_path IS NULL OR source_path NOT IN (SELECT source_path FROM scope WHERE source_path IS NOT NULL)) AND (chunk_id IS NULL OR chunk_id NOT IN (SELECT chunk_id FROM fresh WHERE chunk_id IS NOT NULL)) UNION ALL SELECT * FROM fresh")
def src8_merge(spark: SparkSession, sf: str) -> DataFrame:
    """SRC7, SRC8: rows of changed documents replaced, new ones added."""
    idx, scope, rows = _index(spark, sf)
    return merged(idx, rows, scope)


@query("src9_delete", f"WITH {INDEX_SQL} SELECT * FROM idx WHERE source_path IS NULL OR source_path NOT IN (SELECT source_path FROM scope WHERE source_path IS NOT NULL)")
def src9_delete(spark: SparkSession, sf: str) -> DataFrame:
    """SRC9: the index without some paths."""
    idx, scope, _ = _index(spark, sf)
    return without_paths(idx, scope)


@query("agg6_index_counts", f"WITH per AS (SELECT document_id, count(*) AS n, count(*) FILTER (chunk_type IN ({SEARCH_SQL})) AS s, max(coalesce(len(vector), -1)) AS d FROM research_chunk GROUP BY document_id) SELECT count(*) AS documents, coalesce(sum(n), 0) AS chunks, coalesce(sum(s), 0) AS searchable, count(*) FILTER (coalesce(s, 0) = 0) AS skipped, max(d) AS dimension FROM (SELECT DISTINCT document_id FROM parsed_document) LEFT JOIN per USING (document_id)")
def agg6_index_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG6: counts of the index."""
    return index_summary(table(spark, sf, "parsed_document"), table(spark, sf, "research_chunk"))


@query("feed_event_windows", "SELECT time_bucket(INTERVAL 10 minutes, ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def feed_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Extra: events by ten minutes and type, as the streaming feed counts them."""
    return windowed_counts(table(spark, sf, "events"), "ts", "event_type")
