"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.mixing import mix, shares
from vellum.llm.neardup import group_pairs, near_duplicates
from vellum.llm.packing import containers, fill_report, pack
from vellum.llm.scan import repaired_paragraphs, scan_faults
from vellum.llm.similar import similar_pairs
from vellum.llm.split import split_oversized
from vellum.llm.tokens import with_tokens
from vellum.llm.truncation import length_limits, truncated, truncation_rates
from vellum.plans.shared import table, written

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks where one is among the 5 most similar others of the other."""
    return similar_pairs(table(spark, sf, "research_chunk"), "chunk_id", "vector").select(F.col("id_a").alias("chunk_a"), F.col("id_b").alias("chunk_b"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of scanned pages by line of raw_text."""
    return scan_faults(table(spark, sf, "page_content"), F.col("raw_text"), table(spark, sf, "lexicon"))


def p2_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Repaired paragraphs of each document, from raw_text."""
    return repaired_paragraphs(table(spark, sf, "page_content"), F.col("raw_text"), table(spark, sf, "lexicon"))


def p2_paragraphs_text(spark: SparkSession, sf: str) -> DataFrame:
    """Repaired paragraphs of each document, from the layout-cleaned text."""
    return repaired_paragraphs(table(spark, sf, "page_content"), F.col("text"), table(spark, sf, "lexicon"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all chunk and page texts above 700 tokens."""
    chunk = table(spark, sf, "research_chunk").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text")
    page = table(spark, sf, "page_content").select(F.lit("page").alias("item_kind"), F.col("page_id").cast("string").alias("item_id"), "text")
    return split_oversized(chunk.unionByName(page), F.col("item_kind"), F.col("item_id"), F.col("text"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The coarsest boundary that serves for each text above 700 tokens."""
    return p4_pieces(spark, sf).where("piece_no = 0").select("item_kind", "item_id", "boundary")


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    chunk = table(spark, sf, "research_chunk").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text")
    return chunk.unionByName(table(spark, sf, "evidence_item").select(F.lit("evidence").alias("item_kind"), F.col("evidence_id").alias("item_id"), "text"))


def _recurring(spark: SparkSession, sf: str, count_links: bool) -> DataFrame:
    return near_duplicates(_passages(spark, sf), F.col("item_kind"), F.col("item_id"), F.col("text"), size=3, threshold=0.6, min_words=40, bands=36, rows=4, count_links=count_links)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of records of one kind whose passages recur with small edits."""
    return group_pairs(_recurring(spark, sf, False)).withColumnRenamed("kind", "item_kind")


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each record with its group and number of links."""
    return _recurring(spark, sf, True).withColumnsRenamed({"kind": "item_kind", "id": "item_id"})


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return written(with_tokens(docs, [F.col("doc_id").alias("item_id"), F.col("source")], F.col("text")), "sizes")


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_sizes(spark, sf), "item_id", "tokens")


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of 2,048 tokens with what they hold and their unused space."""
    return containers(_packed(spark, sf))


def p6_placement(spark: SparkSession, sf: str) -> DataFrame:
    """The container of each document, or of each piece of one above the capacity."""
    return _packed(spark, sf).withColumnRenamed("item_id", "doc_id")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and unused space altogether."""
    return fill_report(_packed(spark, sf))


def p7_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Documents drawn to meet the target shares, with the number of the copy."""
    return mix(_sizes(spark, sf), table(spark, sf, "mix_target")).select(F.col("item_id").alias("doc_id"), "source", "copy", "tokens")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted and actual share of each source."""
    sizes, targets = _sizes(spark, sf), table(spark, sf, "mix_target")
    return shares(mix(sizes, targets), sizes, targets)


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return truncated(table(spark, sf, "documents"), F.col("doc_id"), F.col("source"), F.col("text"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text was cut off."""
    return _judged(spark, sf).where("truncated and item_id is not null").select(F.col("item_id").alias("doc_id")).distinct()


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source's texts are cut off."""
    return truncation_rates(_judged(spark, sf))


def p8_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths, under several ways of counting, at which a source's texts pile up."""
    return length_limits(table(spark, sf, "documents"), F.col("source"), F.col("text"))


_ALL = (p1_found, p2_found, p2_paragraphs, p2_paragraphs_text, p4_found, p4_pieces, p5_found, p5_groups, p6_containers, p6_placement, p6_report, p7_shares, p7_selection, p8_found, p8_rates, p8_limits)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

_VECTORS = """v AS (SELECT chunk_id, list_transform(vector, lambda x: x::double / sqrt(list_sum(list_transform(vector, lambda y: y::double * y::double))))::double[64] AS u
 FROM (SELECT DISTINCT chunk_id, vector FROM research_chunk WHERE chunk_id IS NOT NULL AND len(vector) = 64)
 WHERE len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"""

_PARTS = r"""
long AS (SELECT item_kind, item_id, text FROM (SELECT DISTINCT 'chunk' AS item_kind, chunk_id AS item_id, text FROM research_chunk UNION ALL SELECT DISTINCT 'page', page_id::varchar, text FROM page_content)
 WHERE item_id IS NOT NULL AND len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{Z}\p{L}\p{N}]')) > 700),
pars AS (SELECT *, unnest(regexp_split_to_array(text, '\n(?:[ \t\r\f\v\p{Zs}]*\n)+')) AS par FROM long),
ends AS (SELECT item_kind, item_id, par, regexp_replace(regexp_replace(par, '(^|[^\p{L}\p{N}])(Fig|Figs|Eq|Eqs|Ref|Refs|al|cf|vs|ca|approx)\.', '\1\2' || chr(1), 'g'), '([.!?])([\s\p{Z}]+[A-Z])', '\1' || chr(2) || '\2', 'g') AS p FROM pars),
sents AS (SELECT item_kind, item_id, unnest(string_split(p, chr(2))) AS sent FROM ends),
runs AS (SELECT item_kind, item_id, unnest(regexp_split_to_array(text, '[\s\p{Z}]+')) AS run FROM long),
most AS (SELECT item_kind, item_id, max(len(regexp_extract_all(par, '[\p{L}\p{N}]+|[^\s\p{Z}\p{L}\p{N}]'))) AS par FROM pars GROUP BY ALL),
most_s AS (SELECT item_kind, item_id, max(len(regexp_extract_all(sent, '[\p{L}\p{N}]+|[^\s\p{Z}\p{L}\p{N}]'))) AS sent FROM sents GROUP BY ALL),
most_r AS (SELECT item_kind, item_id, max(len(regexp_extract_all(run, '[\p{L}\p{N}]+|[^\s\p{Z}\p{L}\p{N}]'))) AS run FROM runs GROUP BY ALL)
"""

_GROUPS = r"""
texts AS (SELECT DISTINCT 'chunk' AS item_kind, chunk_id AS id, text FROM research_chunk WHERE chunk_id IS NOT NULL UNION ALL SELECT DISTINCT 'evidence', evidence_id, text FROM evidence_item WHERE evidence_id IS NOT NULL),
words AS (SELECT item_kind, id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM texts WHERE text IS NOT NULL),
runs AS (SELECT DISTINCT item_kind, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM words WHERE len(w) >= 40),
sizes AS (SELECT item_kind, id, count(*) AS n FROM runs GROUP BY ALL),
common AS (SELECT a.item_kind, a.id AS a, b.id AS b, count(*) AS c FROM runs a JOIN runs b USING (item_kind, run) WHERE a.id <> b.id GROUP BY ALL),
edges AS (SELECT c.item_kind, a, b FROM common c JOIN sizes x ON x.item_kind = c.item_kind AND x.id = a JOIN sizes y ON y.item_kind = c.item_kind AND y.id = b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT * FROM edges UNION SELECT r.item_kind, r.a, e.b FROM reach r JOIN edges e ON e.item_kind = r.item_kind AND e.a = r.b)
"""

# texts with the same runs are one: of links to them the least id counts
_LINKS = """
closed AS (SELECT item_kind, a AS id, min(b) AS least_id FROM reach GROUP BY ALL),
weighed AS (SELECT e.item_kind, e.a, e.b, x.n = y.n AND c.c = x.n AS same FROM edges e JOIN common c USING (item_kind, a, b) JOIN sizes x ON x.item_kind = e.item_kind AND x.id = e.a JOIN sizes y ON y.item_kind = e.item_kind AND y.id = e.b),
first AS (SELECT item_kind, a AS id, min(b) AS twin FROM weighed WHERE same GROUP BY ALL),
degree AS (SELECT w.item_kind, w.a AS id, count(DISTINCT least(w.b, coalesce(f.twin, w.b))) AS links FROM weighed w LEFT JOIN first f ON f.item_kind = w.item_kind AND f.id = w.b WHERE NOT same GROUP BY ALL)
"""

_CUT = r"""
d AS (SELECT doc_id, source, text, trim(text, chars) AS body FROM documents, (SELECT list_reduce(list_transform([32, 9, 10, 13, 11, 12, 28, 29, 30, 31, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8203, 8232, 8233, 8239, 8287, 12288, 65279], lambda n: chr(n)), lambda a, b: a || b) AS chars)),
m AS (SELECT doc_id, source, text, length(text) AS c, octet_length(encode(text)) AS u, length(regexp_replace(text, '[\x00-\x7f]', '', 'g')) AS latin, octet_length(encode(regexp_replace(text, '[^\x{10000}-\x{10ffff}]', '', 'g'))) // 4 AS beyond,
  length(text) - length(translate(text, '&', '')) AS amp, length(text) - length(translate(text, '<>', '')) AS lt, length(text) - length(translate(text, chr(34) || chr(39), '')) AS quo,
  length(text) - length(translate(text, chr(34) || chr(92) || chr(10) || chr(13) || chr(9) || chr(8) || chr(12), '')) + 5 * (length(text) - length(regexp_replace(text, '[\x00-\x07\x0b\x0e-\x1f]', '', 'g'))) AS js,
  length(text) - length(translate(text, chr(10), '')) - (length(text) - length(replace(text, chr(13) || chr(10), chr(10)))) AS crlf FROM d WHERE body <> '' AND text <> ''),
ms AS (SELECT doc_id, source, text, unnest(['chars', 'utf8', 'utf16', 'chars_xml', 'chars_xml_text', 'utf8_xml', 'utf8_xml_text', 'chars_json', 'utf8_json', 'ascii_json', 'chars_crlf', 'utf8_crlf']) AS measure,
  unnest([c, u, c + beyond, c + 4 * amp + 3 * lt + 5 * quo, c + 4 * amp + 3 * lt, u + 4 * amp + 3 * lt + 5 * quo, u + 4 * amp + 3 * lt, c + js, u + js, c + js + 5 * latin + 6 * beyond, c + crlf, u + crlf]) AS n FROM m),
cnt AS (SELECT source, measure, n, count(DISTINCT text) AS texts FROM ms GROUP BY ALL),
win AS (SELECT source, measure, n, texts, sum(texts) OVER (PARTITION BY source, measure ORDER BY n RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS near,
  (sum(texts) OVER (PARTITION BY source, measure ORDER BY n RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) - sum(texts) OVER (PARTITION BY source, measure ORDER BY n RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)) * 4 / 94.0 AS expected FROM cnt),
lim AS (SELECT *, max(near) OVER (PARTITION BY source, measure ORDER BY n RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS most FROM win WHERE texts >= 3 AND near >= expected + 6 * sqrt(expected) + 3),
piled AS (SELECT DISTINCT doc_id FROM ms JOIN lim ON ms.source IS NOT DISTINCT FROM lim.source AND ms.measure = lim.measure AND ms.n = lim.n AND near = most),
b AS (SELECT doc_id, source, body, right(regexp_extract(body, '([^\n\r]*)$', 1), 80) AS tail, regexp_extract(body, '([^\n\r]*)$', 1) AS last FROM d WHERE body <> ''),
e AS (SELECT *, regexp_matches(tail, '(\.\.\.|…|\[\s*(\.\.\.|…|more|cont[^\]]{0,20})\s*\]|\(\s*(\.\.\.|…|more|cont[^)]{0,20})\s*\))$') AS omitted,
  regexp_matches(tail, '(^|[^\p{L}\p{N}])(Fig|Figs|Eq|Eqs|Ref|Refs|al|cf|vs|ca|approx|Nr|No|Abb|bzw|vgl|ej|éd|e\.g|i\.e|z\.B)\.$') AS abbreviated, regexp_matches(tail, '(^|[^\p{N}.,])\p{N}+\.$') AS number,
  regexp_matches(last, '^\s*([-*•–—·]|\(?\p{N}{1,3}[.)]|\(?[a-z]\))\s') OR contains(last, chr(9)) OR regexp_matches(last, '^\s*\|') OR regexp_matches(last, '(?i)^\s*(key ?words|tags|index terms|mots[- ]cl[ée]s|schlagw[oö]rter|palabras clave|shelf ?mark|signatur|cote|signatura|call number|doi|isbn|issn)\b') AS line,
  length(body) <= 120 AND NOT regexp_matches(body, '[\n\r]') AND NOT regexp_matches(body, '[.!?;,:]\s') AND len(regexp_split_to_array(body, '[\s\p{Z}]+')) <= 12 AS title FROM b),
s AS (SELECT *, regexp_matches(tail, '[.!?。]["''”’»«)\]]*$') AND NOT omitted AS stop FROM e),
cut AS (SELECT doc_id, source, omitted OR abbreviated OR (NOT stop AND NOT line AND NOT title) OR (((stop AND number AND NOT abbreviated) OR (NOT omitted AND NOT stop AND title AND NOT line)) AND doc_id IN (SELECT doc_id FROM piled)) AS cut FROM s)
"""

# The rest can't be said in SQL: edit distances over a trie, a public tokenizer, placing one item after another.
SQL: dict[str, str] = {
    "p1_found": f"WITH {_VECTORS}, near AS (SELECT a.chunk_id AS a, b.chunk_id AS b FROM v a JOIN v b ON a.chunk_id <> b.chunk_id QUALIFY row_number() OVER (PARTITION BY a.chunk_id ORDER BY array_inner_product(a.u, b.u) DESC, b.chunk_id) <= 5) SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM near",
    "p4_found": f"WITH {_PARTS} SELECT item_kind, item_id, CASE WHEN par <= 700 THEN 'paragraph' WHEN sent <= 700 THEN 'sentence' WHEN run <= 700 THEN 'word' ELSE 'none' END AS boundary FROM most JOIN most_s USING (item_kind, item_id) JOIN most_r USING (item_kind, item_id)",
    "p5_found": f"WITH RECURSIVE {_GROUPS} SELECT DISTINCT item_kind, a AS id_a, b AS id_b FROM reach WHERE a < b",
    "p5_groups": f"WITH RECURSIVE {_GROUPS}, {_LINKS} SELECT x.item_kind, x.id AS item_id, least(x.id, coalesce(g.least_id, x.id)) AS group_id, coalesce(l.links, 0) AS links FROM sizes x LEFT JOIN closed g USING (item_kind, id) LEFT JOIN degree l USING (item_kind, id)",
    "p8_found": f"WITH {_CUT} SELECT doc_id FROM cut WHERE cut",
    "p8_rates": f"WITH {_CUT}, j AS (SELECT source, coalesce(cut, false) AS cut FROM documents LEFT JOIN (SELECT doc_id, cut FROM cut) USING (doc_id)) SELECT source, count(*) AS texts, count(*) FILTER (cut) AS truncated, round(count(*) FILTER (cut) / count(*), 6) AS rate FROM j GROUP BY source",
    "p8_limits": f'WITH {_CUT} SELECT source, measure, n AS "limit", near AS texts, round(expected, 3) AS expected FROM lim WHERE near = most',
}
