"""Scalar text functions as Column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is taken off the ends of texts.
BLANK = " \t\n\r\x0b\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of letters or digits, or any other single character but white space. Java and RE2 read it alike.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
WORD = r"[A-Za-z][A-Za-z0-9_-]*"
CITATION = r"\[S(\d+)\]"

# Words that are no query terms.
STOP_WORDS = (
    "what when where which who whom whose why how are was were will would could should the and for from with without into onto about "
    "this that these those their there they them have has had does did doing can may might its our your use used using based between "
    "through within explain describe discuss"
).split()
# Any of these within a paragraph marks publisher's matter.
METADATA_SIGNALS = (
    "view the article online",
    "permissions",
    "terms of service",
    "issn",
    "isbn",
    "copyright ©",
    "copyright (c)",
    "all rights reserved",
    "reprints and permissions",
    "downloaded from http",
    "library of congress control number",
    "printed in china",
    "printed in the united states",
)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(c, F.lit(BLANK))


def sha256_of(content: Column) -> Column:
    """[TXT1] Hash of a file's content, in hexadecimal."""
    return F.sha2(content, 256)


def box_text(raw: Column, span: Column) -> Column:
    """[TXT2] The stripped slice ``[start, stop)`` of ``raw``; empty where the span is missing, not a pair, negative, reversed or begins beyond the end. ``stop`` is clamped."""
    start, stop = F.try_element_at(span, F.lit(1)), F.try_element_at(span, F.lit(2))
    good = raw.isNotNull() & (F.size(span) == 2) & (start >= 0) & (stop > start) & (start < F.length(raw))
    return F.when(F.coalesce(good, F.lit(False)), strip(F.substring(raw, start + 1, F.least(stop, F.length(raw)) - start))).otherwise("")


def join_segments(segments: Column) -> Column:
    """[TXT3] Segments parted by blank lines; one that ends in a hyphen is glued to a next that begins in lower case. Empty segments are left out; none give ''."""

    def glue(done: Column, s: Column) -> Column:
        word = done.endswith("-") & s.rlike(r"^\p{Ll}")
        return F.when(done == "", s).when(word, F.concat(F.substring(done, F.lit(1), F.length(done) - 1), s)).otherwise(F.concat(done, F.lit("\n\n"), s))

    texts = F.filter(F.transform(segments, strip), lambda s: s.isNotNull() & (s != ""))
    return F.coalesce(F.aggregate(texts, F.lit("").cast("string"), glue), F.lit(""))


def clean_heading(c: Column) -> Column:
    """[TXT5] A heading without Markdown marks and tags."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"^#{1,6}\s*", ""), r"</?[^>]+>", "")
    return strip(F.replace(F.translate(bare, "*_", ""), F.lit("~~"), F.lit("")))


def normalize(c: Column) -> Column:
    """[TXT6] Conservative clean-up: no replacement characters or soft hyphens, plain spaces and line ends, at most one blank line; null gives ''."""
    x = F.translate(F.coalesce(c, F.lit("")), "\xa0\ufffd\xad", " ")
    x = F.translate(F.replace(x, F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def normalize_heading(c: Column) -> Column:
    """[TXT7] A heading as it is classified: lower case, letters, digits and ``&:/-`` only; digits stay, so numbered headings match no name."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean_heading(c)), r"[^a-z0-9\s&:/-]", ""), r"\s+", " "))


def looks_like_metadata(c: Column) -> Column:
    """[TXT9] Holds a phrase of publisher's matter; null does not."""
    low, out = F.lower(c), F.lit(False)
    for s in METADATA_SIGNALS:
        out = out | low.contains(s)
    return F.coalesce(out, F.lit(False))


def starts_with_lowercase(c: Column) -> Column:
    """[TXT10] The first letter is lower case; without a letter, false."""
    return F.coalesce(c.rlike(r"^\P{L}*\p{Ll}"), F.lit(False))


def tokens(c: Column) -> Column:
    """[TXT11] Tokens of the default tokenizer."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def count_tokens(c: Column) -> Column:
    """[TXT11] Number of tokens; 0 for null."""
    return F.coalesce(F.size(tokens(F.coalesce(c, F.lit("")))), F.lit(0))


def tokenize_words(c: Column) -> Column:
    """[TXT12] Lower-case words that begin with a letter."""
    return F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.lower)


def query_terms(c: Column) -> Column:
    """[TXT13] Distinct words of four letters or more that are no stop words, in order."""
    return F.array_distinct(F.filter(tokenize_words(c), lambda w: (F.length(w) >= 4) & ~w.isin(STOP_WORDS)))


def anchor_terms(terms: Column) -> Column:
    """[TXT14] Terms with a digit or hyphen."""
    return F.filter(terms, lambda w: w.rlike("[0-9-]"))


def normalize_paragraph(c: Column) -> Column:
    """[TXT15] Single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, BLANK, " " * len(BLANK)), " +", " ")))


def format_pages(a: Column, b: Column) -> Column:
    """[TXT16] 'n' or 'a-b'."""
    return F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string")))


def citation_label(filename: Column, a: Column, b: Column) -> Column:
    """[TXT17] '[file, p. n]' or '[file, pp. a-b]'."""
    return F.concat(F.lit("["), filename, F.when(a == b, F.lit(", p. ")).otherwise(F.lit(", pp. ")), format_pages(a, b), F.lit("]"))


def remove_citations(c: Column) -> Column:
    """[TXT18] Without source marks, bullets at the ends and repeated white space."""
    x = F.regexp_replace(F.regexp_replace(c, CITATION, ""), r"\s+", " ")
    return F.trim(x, F.lit(" \t\n-•"))


def source_ids(c: Column) -> Column:
    """[TXT19] Distinct cited ids 'S1'… in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(CITATION), F.lit(1)), lambda n: F.concat(F.lit("S"), n)))


def is_substantive(c: Column) -> Column:
    """[TXT20] At least eight words besides source marks."""
    return F.size(F.regexp_extract_all(remove_citations(c), F.lit(r"\b[\p{L}\p{N}_]+\b"), F.lit(0))) >= 8


def has_incomplete_citation(c: Column) -> Column:
    """[TXT21] Ends within a source mark."""
    return F.rtrim(c, F.lit(BLANK)).rlike(r"\[S\d*$")


def stable_id(parts: list[Column]) -> Column:
    """[TXT24] The first 24 hexadecimal digits of the hash of the parts, joined by '|'."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def safe_double(c: Column, default: float) -> Column:
    """[TXT25] A number; the default for null, NaN and what is none."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(x)


def normalize_label(c: Column) -> Column:
    """[TXT26] Stripped lower case; null gives ''."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def preview(c: Column, n: int, mark: str = "...") -> Column:
    """[TXT27] At most ``n`` characters, then a mark."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def caption_like(chunk_type: Column, section: Column) -> Column:
    """[FIL4] A caption by its type or by how its section begins."""
    s = normalize_label(section)
    begins = F.lit(False)
    for p in ("figure ", "figure:", "fig. ", "fig ", "table ", "table:"):
        begins = begins | s.startswith(p)
    return (normalize_label(chunk_type) == "caption") | begins
