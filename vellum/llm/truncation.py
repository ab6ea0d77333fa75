"""Texts that were cut off, by hidden length limits and by their endings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Abbreviations at which no sentence ends.
ABBREVIATIONS = ("Fig", "Figs", "Eq", "Eqs", "Ref", "Refs", "al", "cf", "vs", "ca", "approx", "Nr", "No", "Abb", "bzw", "vgl", "ej", "éd", "e.g", "i.e", "z.B")
#: Closing quotes and brackets that may follow a full stop.
CLOSING = r"[\"'”’»«)\]]*"

#: White space at the ends of texts.
BLANK = " \t\n\r\x0b\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
# Labels of lines that end a text without a full stop.
LABEL = r"(?i)^\s*(?:key ?words|tags|index terms|mots[- ]cl[ée]s|schlagw[oö]rter|palabras clave|shelf ?mark|signatur|cote|signatura|call number|doi|isbn|issn)\b"


def _count(text: Column, chars: str) -> Column:
    """How many of ``chars`` the text has; each is searched for in the bytes, which is faster than to translate."""
    out = F.lit(0)
    for c in chars:
        out = out + F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return out


#: Ways of counting a text's length.
MEASURES = ("chars", "utf8", "utf16", "chars_xml", "chars_xml_text", "utf8_xml", "utf8_xml_text", "chars_json", "utf8_json", "ascii_json", "chars_crlf", "utf8_crlf")


def _measure(place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in MEASURES]), place + 1)


def with_measures(df: DataFrame, text: str) -> DataFrame:
    """Adds ``lengths``: the text's length under other encodings, escapes and line ends, in the order of ``MEASURES``."""
    x = F.col(text)
    chars, utf8 = F.length(x), F.octet_length(x)
    plain = utf8 == chars  # ASCII alone
    # worked out once and used by several measures: the optimizer keeps this step apart
    base = {
        "_c": chars,
        "_u": utf8,
        "_latin": F.when(plain, 0).otherwise(chars - F.length(F.regexp_replace(x, r"[^\x00-\x7f]+", ""))),  # characters beyond ASCII
        "_far": F.when(plain, 0).otherwise((F.octet_length(F.regexp_replace(x, r"[^\x{10000}-\x{10ffff}]+", "")) / 4).cast("int")),  # of two UTF-16 units
        "_amp": _count(x, "&"),
        "_angle": _count(x, "<>"),
        "_double": _count(x, '"'),
        "_single": _count(x, "'"),
        "_lines": _count(x, "\n"),
        "_short": _count(x, "\\\r\t\b\f"),
        "_pairs": chars - F.length(F.replace(x, F.lit("\r\n"), F.lit("\n"))),
        "_control": chars - F.length(F.regexp_replace(x, r"[\x00-\x07\x0b\x0e-\x1f]+", "")),
    }
    c, u, latin, far = (F.col(k) for k in ("_c", "_u", "_latin", "_far"))
    xml_text = 4 * F.col("_amp") + 3 * F.col("_angle")
    xml = xml_text + 5 * F.col("_double") + 5 * F.col("_single")
    # control characters without a short escape take six
    json = F.col("_double") + F.col("_lines") + F.col("_short") + 5 * F.col("_control")
    crlf = F.col("_lines") - F.col("_pairs")
    measures = {
        "chars": c,
        "utf8": u,
        "utf16": c + far,
        "chars_xml": c + xml,
        "chars_xml_text": c + xml_text,
        "utf8_xml": u + xml,
        "utf8_xml_text": u + xml_text,
        "chars_json": c + json,
        "utf8_json": u + json,
        "ascii_json": c + json + 5 * latin + 6 * far,
        "chars_crlf": c + crlf,
        "utf8_crlf": u + crlf,
    }
    lengths = F.array(*[measures[k].cast("long") for k in MEASURES])
    return df.withColumns(base).withColumn("lengths", lengths).drop(*base)


def length_limits(df: DataFrame, source: Column, text: Column, *, least: int = 3, reach: int = 50, sigmas: float = 6.0) -> DataFrame:
    """``source, measure, limit, texts, expected``: lengths at which a source's texts pile up.

    Different texts are counted by source, measure and length. A length is a limit if at least ``least``
    texts have it, and with those that fall short of it by up to three units (a character that no longer fitted) there are
    ``least`` and ``sigmas`` standard deviations more than the lengths within ``reach`` would have it. Null sources form a source of their own; null and blank texts don't count.
    """
    named = df.select(source.alias("source"), text.alias("text")).where("trim(text) <> ''")
    # copies of a text count once; only hashes and lengths are moved
    once = with_measures(named, "text").select("source", F.xxhash64("text").alias("h"), F.col("lengths").alias("m")).dropDuplicates(["source", "h"])
    # counts are combined before the shuffle; what is left has a row a length
    counts = once.select("source", F.posexplode("m").alias("place", "n")).groupBy("source", _measure(F.col("place")).alias("measure"), "n").agg(F.count("*").alias("texts"))
    w = Window.partitionBy("source", "measure").orderBy("n")
    near, wide = w.rangeBetween(-3, 0), w.rangeBetween(-reach, reach)
    around = F.sum("texts").over(wide) - F.sum("texts").over(w.rangeBetween(-3, 3))
    return (
        counts.select("source", "measure", "n", "texts", F.sum("texts").over(near).alias("close"), (around * 4 / (2 * reach - 6)).alias("expected"))
        .where((F.col("texts") >= least) & (F.col("close") >= F.col("expected") + sigmas * F.sqrt("expected") + least))
        # of neighbouring lengths the one where most lie
        .withColumn("most", F.max("close").over(w.rangeBetween(-3, 3)))
        .where("close = most")
        .select("source", "measure", F.col("n").alias("limit"), F.col("close").alias("texts"), F.round("expected", 3).alias("expected"))
    )


def with_endings(df: DataFrame, text: str) -> DataFrame:
    """Adds how a text ends: ``unfinished`` prose, ``whole`` (title, list, table, keyword or shelfmark line), ``doubtful``; and ``blank``. Null and blank texts are none of the first three."""
    edge = {"_body": F.rtrim(F.col(text), F.lit(BLANK)), "_start": F.ltrim(F.col(text), F.lit(BLANK))}
    body, start = F.col("_body"), F.col("_start")
    ends = {"_last": F.substring_index(F.substring_index(body, "\n", -1), "\r", -1), "_n": F.length(F.ltrim(body, F.lit(BLANK)))}
    last, tail = F.col("_last"), F.right(F.col("_last"), F.lit(80))  # longer than any of the marks looked for
    omitted = tail.rlike(r"(?:\.\.\.|…|\[\s*(?:\.\.\.|…|more|cont[^\]]{0,20})\s*\]|\(\s*(?:\.\.\.|…|more|cont[^)]{0,20})\s*\))$")
    stop = tail.rlike(r"[.!?。]" + CLOSING + "$") & ~omitted
    abbreviated = tail.rlike(r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.$")
    # a number that may have lost its decimals
    number = tail.rlike(r"(?:^|[^\p{N}.,])\p{N}+\.$")
    line = last.rlike(r"^\s*(?:[-*•–—·]|\(?\p{N}{1,3}[.)]|\(?[a-z]\))\s") | last.contains("\t") | last.rlike(r"^\s*\|") | last.rlike(LABEL)
    head = F.rtrim(F.left(start, F.lit(400)), F.lit(BLANK))
    # a text of that length is all in its head
    title = (F.col("_n") <= 120) & ~head.rlike(r"[\n\r]") & ~head.rlike(r"[.!?;,:]\s") & (F.size(F.split(head, r"(?U)\s+")) <= 12)
    marks = {"_omitted": omitted, "_stop": stop, "_short": abbreviated, "_number": number, "_line": line, "_title": title}
    omitted, stop, abbreviated, number, line, title = (F.col(k) for k in marks)
    judged = {
        "whole": ~omitted & ~stop & (line | title),
        "unfinished": omitted | abbreviated | (~stop & ~line & ~title),
        "doubtful": (stop & number & ~abbreviated) | (~omitted & ~stop & title & ~line),
    }
    full = F.coalesce(F.col("_n") > 0, F.lit(False))
    out = df.withColumns(edge).withColumns(ends).withColumns(marks)
    out = out.withColumns({"blank": ~full, **{k: full & F.coalesce(v, F.lit(False)) for k, v in judged.items()}})
    return out.drop(*edge, *ends, *marks)


def truncated(df: DataFrame, item_id: Column, source: Column, text: Column) -> DataFrame:
    """``item_id, source, truncated, at_limit``: of every text whether it was cut.

    Cut are texts that end within a word or sentence of running prose, with or without a sign
    of omission. A last number with a full stop, or a title, is doubtful: it is a cut only at one of the limits found for the source.
    Lists, tables, keyword and shelfmark lines are whole. Null and blank texts are not cut.
    """
    rows = df.select(item_id.alias("item_id"), source.alias("source"), text.alias("text"))
    limits = length_limits(rows, F.col("source"), F.col("text")).groupBy("source").agg(F.array_distinct(F.collect_list(F.concat_ws("=", "measure", F.col("limit").cast("string")))).alias("limits"))
    # what meets the limits has lengths and marks, but no texts
    judged = with_endings(with_measures(rows, "text"), "text").select("item_id", "source", "unfinished", "doubtful", F.when(~F.col("blank"), F.col("lengths")).alias("lengths"))
    k = F.coalesce(F.col("source"), F.lit("\x00"))
    own = F.transform("lengths", lambda n, i: F.concat_ws("=", _measure(i), n.cast("string")))
    at = F.coalesce(F.arrays_overlap("limits", own), F.lit(False))
    # limits: a row a source
    joined = judged.withColumn("k", k).join(limits.select(k.alias("k"), "limits"), "k", "left")
    return joined.select("item_id", "source", (F.col("unfinished") | (F.col("doubtful") & at)).alias("truncated"), at.alias("at_limit"))


def truncation_rates(judged: DataFrame) -> DataFrame:
    """``source, texts, truncated, rate`` of each source; all rows count, those without text too."""
    n = F.count_if("truncated")
    return judged.groupBy("source").agg(F.count("*").alias("texts"), n.alias("truncated"), F.round(n / F.count("*"), 6).alias("rate"))
