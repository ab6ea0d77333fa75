"""Repair of text from scanned pages.

Running heads, feet and page numbers are found by what recurs at page edges;
words cut at line ends are joined; misrecognised words are looked up by
intersecting Levenshtein automata with a trie of the vocabulary, over a
spelling in which characters that scanners confuse are the same. What is left
is reflowed into paragraphs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.levenshtein import Trie
from vellum.plans.shared import written

# Groups of characters that optical recognition confuses, and characters that it takes for several, written in
# the strokes they share: n, u, h and b are two strokes, m is three, d is c and a stroke.
CONFUSED = ("il1|r", "o0", "s5", "g9", "ce", "tf", "aä")
STROKES = {"n": "ii", "u": "ii", "h": "ii", "b": "ii", "6": "ii", "m": "iii", "d": "ci", "w": "vv"}
_FOLD = str.maketrans({c: group[0] for group in CONFUSED for c in group} | STROKES)

HYPHENS = "-‐¬­"
PUNCTUATION = ".,;:?!()[]{}\"'“”‘’«»"
#: A vocabulary larger than this is not sent to the executors.
MAX_WORDS = 2_000_000

NUMBER = re.compile(r"[\dlIOoSi|äg]{1,6}")
ROMAN = re.compile(r"(?=[ivxlcdm1])m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})([i1]x|[i1]v|v?[i1]{0,3})")
#: A line that is nothing but a page number, perhaps with the word page and the number of pages.
PAGE_LINE = re.compile(r"[-–—|\[ ]*(?:(?:[Pp][aä][g9][ec]|PAGE|[Pp]\.)\s*)?(?P<n>\S+?)(?:\s+(?:[o0][ft]|OF|/)\s+(?P<m>\S+?))?[-–—|\] ]*")


def fold(word: str) -> str:
    """A spelling that is the same for characters, and strings of them, which scanners confuse: rn and m, ri and n, cl and d."""
    return word.lower().translate(_FOLD)


def is_number(token: str) -> bool:
    """A number whose digits may have been read as letters."""
    return bool(NUMBER.fullmatch(token)) and (any(c.isdigit() for c in token) or all(c in "lIO" for c in token))


def is_page_number(line: str) -> bool:
    """The line holds nothing but a page number; numbers in round brackets are those of equations."""
    m = PAGE_LINE.fullmatch(line)
    if not m:
        return False
    first, last = m["n"], m["m"]
    if first.startswith("("):
        return False
    return (is_number(first) or bool(first and ROMAN.fullmatch(first.lower()))) and (last is None or is_number(last))


def is_sentence_end(line: str) -> bool:
    """The line ends as running prose does; running heads and feet don't."""
    return line[-1:] in ".?!,;:" and not is_page_number(line)


def shape(line: str) -> str:
    """A line without its numbers and in folded spelling, as running lines are compared."""
    out = []
    for token in line.split():
        bare = token.strip(PUNCTUATION + "|-–—")
        if bare and not is_number(bare):
            out.append(fold(bare))
    return " ".join(out)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most + 1`` if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


class Vocabulary:
    """Words with frequencies; finds the right word for a misread one."""

    def __init__(self, freq: dict[str, int]):
        self.freq = freq
        self.by_fold: dict[str, list[str]] = {}
        for w in freq:
            self.by_fold.setdefault(fold(w), []).append(w)
        self.trie = Trie(self.by_fold)
        self.seen: dict[str, str | None] = {}
        self.near: dict[str, list[str]] = {}

    def __contains__(self, word: str) -> bool:
        return word in self.freq

    def candidates(self, word: str) -> list[tuple[int, str]]:
        """(distance of the folded spellings, word): all that come within the distance allowed for the length.

        Every word is searched at distance 1 at least. Under 8 strokes
        what is found there counts only beside a word of the same strokes.
        """
        f = fold(word)
        most = 0 if len(f) < 8 else 1 if len(f) < 14 else 2
        found = self.trie.within(f, max(most, 1))
        if not most and (not found or found[0][0]):
            return []
        return [(d, w) for d, g in found for w in self.by_fold[g]]

    def nearest(self, word: str) -> list[str]:
        """The candidates with the least sum of folded and plain distance, of these the ones of least folded distance."""
        if word not in self.near:
            if len(self.near) > 200_000:
                self.near.clear()
            ranked = [((d + distance(word, w, 6), d), w) for d, w in self.candidates(word)]
            least = min(ranked)[0] if ranked else None
            self.near[word] = [w for r, w in ranked if r == least]
        return self.near[word]

    def best(self, found: list[str], left: str = "", after: str = "", pairs: dict | None = None) -> str | None:
        """Of words that are as near: the one that stands most often beside the same neighbours, then the most frequent."""
        if len(found) < 2:
            return found[0] if found else None
        pairs = pairs or {}
        left, after = left.strip(PUNCTUATION).lower(), after.strip(PUNCTUATION).lower()
        return min(found, key=lambda w: (-pairs.get((left, w), 0) - pairs.get((w, after), 0), -self.freq[w], w))

    def right(self, word: str, left: str = "", after: str = "", pairs: dict | None = None) -> str | None:
        """The vocabulary word that ``word`` (lower case) was misread from; None if it is right or unknown.

        Candidates rank by the sum of folded and plain distance, then folded
        distance, then how often they stand beside the same neighbours, then frequency.
        """
        return self.best(self.nearest(word), left, after, pairs)

    def unknown(self, token: str) -> str:
        """What has to be looked up for a token as it stands; empty if that is a word of the vocabulary or none at all."""
        bare = token.strip(PUNCTUATION)
        low = bare.lower()
        if not low or low in self.freq or re.fullmatch(r"[\dlO]+|[A-Z]{2,4}-\d+|[\d.,/:;|–—-]+", bare):
            return ""
        plain = unicodedata.normalize("NFKC", low)  # ligatures are no misreadings
        return "" if plain in self.freq else plain

    def misread(self, token: str, left: str = "", after: str = "", pairs: dict | None = None) -> str | None:
        """For a token as it stands: the right word if its characters were misrecognised."""
        if token in self.seen:
            return self.seen[token]
        if len(self.seen) > 1_000_000:
            self.seen.clear()
        plain = self.unknown(token)
        found = self.nearest(plain) if plain else []
        out = self.best(found, left, after, pairs)
        if len(found) < 2:  # does not depend on the neighbours
            self.seen[token] = out
        return out

    def joins(self, stem: str, rest: str) -> tuple[list[str], bool]:
        """The word of which ``stem`` ends one line and ``rest`` begins the next, or several that are as near, and whether it was misread."""
        stem, rest = stem.strip(PUNCTUATION).lower(), rest.strip(PUNCTUATION).lower()
        for w in (stem + rest, stem + "-" + rest):
            if w in self.freq:
                return [w], False
        for w in (stem + rest, stem + "-" + rest):
            plain = unicodedata.normalize("NFKC", w)
            if plain in self.freq:
                return [plain], False
            found = self.nearest(plain) if len(w) > 3 else []
            if found:
                return found, True
        return [], False

    def join(self, stem: str, rest: str, left: str = "", after: str = "", pairs: dict | None = None) -> tuple[str, bool] | None:
        """The first of ``joins`` beside ``left`` and ``after``, and whether it was misread."""
        found, wrong = self.joins(stem, rest)
        return (self.best(found, left, after, pairs), wrong) if found else None

    def doubts(self, token: str, rest: str | None) -> list[str]:
        """The words between which only the neighbours decide, for a token or one that ``rest`` continues; if it doesn't, for ``rest``."""
        found = self.joins(token, rest)[0] if rest is not None else []
        if not found:
            plain = self.unknown(token if rest is None else rest)
            found = self.nearest(plain) if plain else []
        return found if len(found) > 1 else []



def doubtful_words(cases: DataFrame, shared) -> set[str]:
    """The vocabulary's words between which neighbours have to decide in ``cases`` (``word, rest``)."""

    def doubts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(shared.value)
        for b in batches:
            found = {w for token, rest in zip(*(c.to_pylist() for c in b.columns)) for w in v.doubts(token, rest)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    return set(cases.select("word", "rest").mapInArrow(doubts, "word string").distinct().toArrow().column(0).to_pylist())


def neighbours(pages: DataFrame, shared, doubtful: set[str]) -> dict[tuple[str, str], int]:
    """How often words of the vocabulary stand beside each other in all pages, if one of them is doubtful.

    Bounded by the vocabulary: no more pairs than doubtful words times words, twice. Counted by batch before the shuffle.
    """
    if not doubtful:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            found: Counter = Counter()
            for raw in b.column(0).to_pylist():
                ws = [w.strip(PUNCTUATION) for w in raw.lower().split()]
                for i, w in enumerate(ws):
                    if w in doubtful:
                        if i and ws[i - 1] in words:
                            found[ws[i - 1], w] += 1
                        if i + 1 < len(ws) and ws[i + 1] in words and ws[i + 1] not in doubtful:
                            found[w, ws[i + 1]] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["left", "right", "n"])

    rows = pages.select("raw").mapInArrow(count, "left string, right string, n long").groupBy("left", "right").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()), rows.column(2).to_pylist()))


def text_lines(raw: str) -> list[str]:
    """Lines parted at each line feed, without white space at their ends."""
    return [x.strip() for x in raw.split("\n")]


#: Lines at the top and at the bottom of a page that may be furniture.
TOP, BOTTOM = 2, 3


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page the shapes of its edge lines, and of its short lines elsewhere (``edge`` false)."""
    for b in batches:
        out: list[tuple] = []
        for doc, page, raw in zip(*(c.to_pylist() for c in b.columns)):
            full = [x for x in text_lines(raw) if x]
            for i, line in enumerate(full):
                at_edge = i < TOP or i >= len(full) - BOTTOM
                if (at_edge or len(line) <= 40) and not is_sentence_end(line):
                    s = shape(line)
                    if s:
                        out.append((doc, page, s, at_edge))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.string(), pa.int64(), pa.string(), pa.bool_()])], names=["doc", "page_id", "shape", "edge"])


def running_lines(pages: DataFrame, min_docs: int = 3) -> DataFrame:
    """``doc, running``: the shapes of each document's running heads and feet.

    A shape runs if it stands at the edge of two of the document's pages, or in ``min_docs``
    documents, and not for the most part elsewhere as headings and equation
    numbers do. Repeated pages count once.
    """
    seen = written(pages.select("doc", "page_id", "raw").mapInArrow(_edges, "doc string, page_id long, shape string, edge boolean").groupBy("doc", "page_id", "shape").agg(F.max("edge").alias("edge")).groupBy("doc", "shape").agg(F.count_if("edge").alias("at_edge"), F.count_if(~F.col("edge")).alias("inside")), "page-edges")
    everywhere = seen.groupBy("shape").agg(F.count_if(F.col("at_edge") > 0).alias("docs"), F.sum("at_edge").alias("edges"), F.sum("inside").alias("insides"))
    known = everywhere.where((F.col("docs") >= min_docs) | (F.col("insides") > 0))
    return (
        seen.where("at_edge > 0")
        .join(known, "shape", "left")
        .withColumns({"docs": F.coalesce("docs", F.lit(0)), "edges": F.coalesce("edges", "at_edge"), "insides": F.coalesce("insides", F.lit(0))})
        .where(((F.col("at_edge") >= 2) | (F.col("docs") >= min_docs)) & (F.col("insides") * 10 <= F.col("edges")))
        .groupBy("doc")
        .agg(F.sort_array(F.collect_list("shape")).alias("running"))
    )


class Page:
    """Lines of one page: which are furniture, and what stands in the others."""

    def __init__(self, raw: str, running: list[str], title: str, cache: dict | None = None):
        self.lines = text_lines(raw)
        full = [i for i, x in enumerate(self.lines) if x]
        self.furniture: set[int] = set()
        fast = set(running)
        head = shape(title) if title else ""

        def runs(line: str) -> bool:
            if is_page_number(line):
                return True
            key = (line, tuple(running), head)
            if cache is not None and key in cache:
                return cache[key]
            s = "" if is_sentence_end(line) else shape(line)
            most = len(s) // 8
            yes = bool(s) and s in fast or (len(s) >= 12 and head.startswith(s)) or (len(s) >= 12 and len(line) < 64 and any(distance(s, r, most) <= most for r in running)) or (len(s) >= 16 and len(line) < 64 and bool(head) and distance(s, head[: len(s)], most) <= most)
            if cache is not None:
                if len(cache) > 200_000:
                    cache.clear()
                cache[key] = yes
            return yes

        for edge, most in ((full, TOP), (full[::-1], BOTTOM)):
            for i in edge[:most]:
                if not runs(self.lines[i]):
                    break
                self.furniture.add(i)
        self.body = [i for i in full if i not in self.furniture]


#: Faults that are sure, and cases: 'word' and 'join' (a word cut after ``word``), which ``decided`` settles by their neighbours,
#: 'first' and 'open', 'last' or 'ended' (nothing left to judge), the ends of a page that meet those beside it.
FAULTS = pa.schema([("doc", pa.string()), ("page_id", pa.int64()), ("line_no", pa.int32()), ("fault", pa.string()), ("word", pa.string()), ("rest", pa.string()), ("left", pa.string()), ("after", pa.string()), ("next_page", pa.int64()), ("next_line", pa.int32())])
FAULTS_SQL = "doc string, page_id long, line_no int, fault string, word string, rest string, left string, after string, next_page long, next_line int"
_DOUBT = [("at", pa.int32()), ("word", pa.string()), ("rest", pa.string()), ("left", pa.string()), ("after", pa.string()), ("opens", pa.bool_())]
PARTS = pa.schema([("doc", pa.string()), ("page_id", pa.int64()), ("line_no", pa.int32()), ("fault", pa.string()), ("word", pa.string()), ("opening", pa.string()), ("doubts", pa.list_(pa.struct(_DOUBT)))])
PARTS_SQL = "doc string, page_id long, line_no int, fault string, word string, opening string, doubts array<struct<at int, word string, rest string, left string, after string, opens boolean>>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _pages(shared, with_text: bool):
    """Faults of each page, or the parts of its paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        cache: dict = {}
        for b in batches:
            out: list[tuple] = []
            for doc, page, raw, running, title in zip(*(c.to_pylist() for c in b.columns)):
                p = Page(raw, running or [], title or "", cache)
                words = {i: p.lines[i].split() for i in p.body}
                if with_text:
                    out.extend((doc, page, *r) for r in _reflow(p, words, vocabulary))
                    continue
                out.extend((doc, page, i + 1, "furniture", "", *NO_CASE) for i in p.furniture)
                out.extend((doc, *r) for r in _faults(page, p, words, vocabulary))
            yield _batch(out, PARTS if with_text else FAULTS)

    return run


NO_CASE = (None, None, None, None, None)


def _is_open(token: str) -> bool:
    return len(token) > 1 and token[-1] in HYPHENS and token[-2].isalpha()


def _beside(ws: list[str], k: int, before: str, after: str) -> tuple[str, str]:
    """The words before and after the k-th of a line, of which ``before`` and ``after`` are the neighbours."""
    return ws[k - 1] if k else before, ws[k + 1] if k + 1 < len(ws) else after


def _around(p: Page, words: dict[int, list[str]], at: int) -> tuple[str, str]:
    """The last word of the body line before the one at ``at`` and the first of the next."""
    return words[p.body[at - 1]][-1] if at else "", words[p.body[at + 1]][0] if at + 1 < len(p.body) else ""


def _cut(page: int, line: int, next_page: int, next_line: int, stem: str, word: str, wrong: bool) -> Iterator[tuple]:
    """Rows of a word that is cut after ``stem``."""
    yield page, line, "hyphen", word, *NO_CASE
    if wrong:
        later = word.startswith(stem.strip(PUNCTUATION).lower())
        yield next_page if later else page, next_line if later else line, "misread", word, *NO_CASE


def _faults(page: int, p: Page, words: dict[int, list[str]], v: Vocabulary) -> Iterator[tuple]:
    known, misread = v.seen, v.misread
    for at, i in enumerate(p.body):
        ws = words[i]
        lo, hi = 0, len(ws)
        before, after = _around(p, words, at)
        if at == 0:
            yield page, i + 1, "first", ws[0], None, "", _beside(ws, 0, before, after)[1], None, None
            lo = 1
        elif _is_open(words[p.body[at - 1]][-1]) and v.joins(words[p.body[at - 1]][-1][:-1], ws[0])[0]:
            lo = 1
        cut = _is_open(ws[-1]) and (hi > lo or at == 0)
        if at + 1 == len(p.body):
            yield page, i + 1, "open" if cut else "last" if hi > lo else "ended", ws[-1], None, _beside(ws, hi - 1, before, "")[0], "", None, None
            hi -= 1
        elif cut:
            stem, following, line = ws[-1][:-1], words[p.body[at + 1]], p.body[at + 1] + 1
            found, wrong = v.joins(stem, following[0])
            if found:
                hi -= 1
            if len(found) == 1:
                yield from _cut(page, i + 1, page, line, stem, found[0], wrong)
            elif found:
                yield page, i + 1, "join", stem, following[0], _beside(ws, hi, before, "")[0], _beside(following, 0, "", _around(p, words, at + 1)[1])[1], page, line
        for k in range(lo, hi):
            w = ws[k]
            right = known[w] if w in known else misread(w)
            if right and w in known:
                yield page, i + 1, "misread", right, *NO_CASE
            elif right:  # kept are only those that don't hang on their neighbours
                yield page, i + 1, "word", w, None, *_beside(ws, k, before, after), None, None


def decided(shared, beside):
    """Faults that the cases come to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, pairs = Vocabulary(shared.value), beside.value
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                if r["fault"] == "join":
                    word, wrong = v.join(r["word"], r["rest"], r["left"], r["after"], pairs)
                    out.extend((r["doc"], *c) for c in _cut(r["page_id"], r["line_no"], r["next_page"], r["next_line"], r["word"], word, wrong))
                elif right := v.misread(r["word"], r["left"], r["after"], pairs):
                    out.append((r["doc"], r["page_id"], r["line_no"], "misread", right, *NO_CASE))
            yield _batch(out, FAULTS)

    return run


def _mended(w: str, right: str | None, opens: bool) -> str:
    """The token with its right word; ``opens``: it begins a line."""
    if not right:
        return unicodedata.normalize("NFKC", w).replace("­", "") if not w.isascii() else w
    bare = w.strip(PUNCTUATION)
    a = w.index(bare)
    return w[:a] + (right.capitalize() if bare[:1].isupper() or (a == 0 and opens and bare[:1] == "l" and right[:1] == "i") else right) + w[a + len(bare) :]


def _whole(stem: str, rest: str, word: str) -> str:
    """The word in place of a token cut after ``stem`` and its ``rest``."""
    lead = stem[: len(stem) - len(stem.lstrip(PUNCTUATION))]
    return lead + (word.capitalize() if stem[len(lead) : len(lead) + 1].isupper() else word) + rest[len(rest.rstrip(PUNCTUATION)) :]


def _reflow(p: Page, words: dict[int, list[str]], v: Vocabulary) -> Iterator[tuple]:
    """Paragraphs of the page: ('start' after a blank line, else 'more'), each with its repaired text, its first token as it stands and its doubts.

    Doubts are words that hang on their neighbours, and the first of the page, which may be the rest of one.
    """
    paragraph: list[str] = []
    doubts: list[tuple] = []
    n, kind, opening = 0, "more", ""

    def part() -> tuple:
        # counted in the text parted at spaces, which a token may get when it is composed
        places = [(at + sum(x.count(" ") for x in paragraph[:at]), *d) for at, *d in doubts]
        return n, kind, " ".join(paragraph), opening, [dict(zip([f[0] for f in _DOUBT], d)) for d in places]

    for at, i in enumerate(p.body):
        blank = at > 0 and any(not p.lines[j] for j in range(p.body[at - 1] + 1, i))
        if blank and not (paragraph and _is_open(paragraph[-1])):
            yield part()
            paragraph, doubts, n, kind = [], [], n + 1, "start"
        around = _around(p, words, at)
        for k, w in enumerate(words[i]):
            if not paragraph:
                opening = w
            left, after = _beside(words[i], k, *around)
            if k == 0 and paragraph and _is_open(paragraph[-1]):
                stem = paragraph[-1][:-1]
                found, _ = v.joins(stem, w)
                if found:
                    paragraph.pop()
                    if len(found) > 1:
                        doubts.append((len(paragraph), stem, w, paragraph[-1] if paragraph else "", after, False))
                    paragraph.append(_whole(stem, w, found[0]))
                    continue
            if k == len(words[i]) - 1 and _is_open(w):
                paragraph.append(w)
                continue
            right = v.misread(w)
            if (at == 0 and k == 0) or (right and w not in v.seen):
                doubts.append((len(paragraph), w, None, left, after, k == 0))
                paragraph.append(w)
            else:
                paragraph.append(_mended(w, right, k == 0))
    if paragraph:
        yield part()


def _source(df: DataFrame, text: Column) -> DataFrame:
    """``doc, page_id, raw, title``; a page without document is one by itself."""
    title = F.col("metadata")["title"] if "metadata" in df.columns else F.lit(None).cast("string")
    doc = F.coalesce(F.col("document_id"), F.concat(F.lit("page "), F.col("page_id").cast("string")))
    return df.select(doc.alias("doc"), F.col("page_id").cast("long").alias("page_id"), text.alias("raw"), title.alias("title")).where("page_id is not null and trim(raw) <> ''")


def _vocabulary(lexicon: DataFrame):
    """The words, sent to all executors; their number is checked."""
    rows = lexicon.select("word", F.coalesce("freq", F.lit(0)).alias("freq")).where("word is not null").limit(MAX_WORDS + 1).toArrow()
    if rows.num_rows > MAX_WORDS:
        raise ValueError(f"a vocabulary of more than {MAX_WORDS} words")
    return lexicon.sparkSession.sparkContext.broadcast(dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())))


def _next_in_document(ends: DataFrame, order: list[str], value: str, block: int = 4096) -> DataFrame:
    """``ends`` with ``after``: the value of the document's next row.

    Rows go to blocks by page number, so that no document is walked by one
    task; the first row of each block is found beforehand for the block that precedes it.
    """
    e = ends.withColumn("block", F.floor(F.col("page_id") / block))
    head = e.groupBy("doc", "block").agg(F.min(F.struct(*order, value)).alias("head"))
    ahead = head.select("doc", "block", F.lead(F.col(f"head.{value}")).over(Window.partitionBy("doc").orderBy("block")).alias("beyond"))
    return e.withColumn("after", F.lead(value).over(Window.partitionBy("doc", "block").orderBy(*order))).join(ahead, ["doc", "block"], "left").withColumn("after", F.coalesce("after", "beyond")).drop("beyond", "block")


def scan_faults(df: DataFrame, text: Column, lexicon: DataFrame) -> DataFrame:
    """``page_id, line_no, fault, word``: furniture, cut words and misread words of scanned pages.

    ``df``: ``document_id, page_id`` and, where there is one, a map
    ``metadata`` with ``title``; pages of one document follow each other by
    page_id. Lines are parted at each line feed and counted from 1. Rows
    without page_id and null or blank texts give nothing; repeated pages
    count once. An empty vocabulary finds furniture only.
    """
    pages = _source(df, text)
    shared = _vocabulary(lexicon)
    joined = pages.join(running_lines(pages), "doc", "left").select("doc", "page_id", "raw", "running", "title")
    found = written(joined.mapInArrow(_pages(shared, False), FAULTS_SQL), "page-faults")
    ends = found.where("fault in ('first', 'open', 'last', 'ended')").select("doc", "page_id", "line_no", "fault", "word", "left", "after").distinct().withColumnRenamed("after", "beside_it").withColumn("turn", F.when(F.col("fault") == "first", 0).otherwise(1))
    ends = ends.withColumn("mark", F.struct("fault", "word", "beside_it", "page_id", "line_no"))
    met = _next_in_document(ends, ["page_id", "turn", "line_no"], "mark").select("doc", "fault", "page_id", "line_no", "word", "left", "beside_it", F.col("after.fault").alias("next_fault"), F.col("after.word").alias("next_word"), F.col("after.beside_it").alias("next_beside"), F.col("after.page_id").alias("next_page"), F.col("after.line_no").alias("next_line"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(shared.value)
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                here, there = (r["doc"], r["page_id"], r["line_no"]), (r["doc"], r["next_page"], r["next_line"])
                if r["fault"] == "first":
                    if not _is_open(r["word"]):
                        out.append((*here, "start", r["word"], None, "", r["beside_it"], None, None))
                    continue
                meets = r["next_fault"] == "first"
                if r["fault"] == "last":
                    out.append((*here, "word", r["word"], None, r["left"], r["next_word"] if meets else "", None, None))
                elif r["fault"] == "open" and meets and v.joins(r["word"][:-1], r["next_word"])[0]:
                    out.append((*here, "join", r["word"][:-1], r["next_word"], r["left"], r["next_beside"], *there[1:]))
                    continue
                if meets and (r["fault"] == "open" or not _is_open(r["next_word"])):
                    out.append((*there, "word", r["next_word"], None, r["word"], r["next_beside"], None, None))
            yield _batch(out, FAULTS)

    ended = written(met.mapInArrow(across, FAULTS_SQL), "page-ends")
    # a page's first word is judged by itself where no page comes before
    follows = met.where("fault <> 'first' and next_fault = 'first'").select("doc", F.col("next_page").alias("page_id"), F.col("next_line").alias("line_no"), F.col("next_word").alias("word")).distinct()
    starts = ended.where("fault = 'start'").join(follows, ["doc", "page_id", "line_no", "word"], "left_anti").withColumn("fault", F.lit("word")).select(*FAULTS.names)
    cases = found.where("fault in ('word', 'join')").unionByName(ended.where("fault <> 'start'")).unionByName(starts)
    beside = df.sparkSession.sparkContext.broadcast(neighbours(pages, shared, doubtful_words(cases, shared)))
    return found.where("fault in ('furniture', 'hyphen', 'misread')").unionByName(cases.mapInArrow(decided(shared, beside), FAULTS_SQL)).select("page_id", "line_no", "fault", "word").distinct()


def repaired_paragraphs(df: DataFrame, text: Column, lexicon: DataFrame, block: int = 4096) -> DataFrame:
    """``document_id, paragraph_no, first_page_id, last_page_id, text``: continuous paragraphs without furniture.

    Words cut at line or page ends are whole, misread ones right, lines are
    joined. A paragraph ends at a blank line, or where a page ends with a
    sentence. Repeated pages count once, pages without text give nothing;
    input as for ``scan_faults``. Text that isn't in the vocabulary stays as it is.
    """
    pages = _source(df, text)
    shared = _vocabulary(lexicon)
    joined = pages.join(running_lines(pages), "doc", "left").select("doc", "page_id", "raw", "running", "title")
    parts = joined.mapInArrow(_pages(shared, True), PARTS_SQL)
    parts = written(parts.groupBy("doc", "page_id", "line_no").agg(F.max(F.struct("fault", "word", "opening", "doubts")).alias("p")).select("doc", "page_id", "line_no", "p.*"), "page-parts")
    ends = parts.select("doc", "page_id", "line_no", F.struct("fault", "page_id", "opening").alias("mark"), F.substring_index("word", " ", -1).alias("last"), F.col("word").rlike(r"[.!?][)\]\"']*$").alias("ended"))
    n = _next_in_document(ends, ["page_id", "line_no"], "mark", block)
    n = n.withColumn("cut", F.coalesce((F.col("after.fault") == "start") | (F.col("ended") & (F.col("after.page_id") != F.col("page_id"))), F.lit(True)).cast("long")).withColumn("block", F.floor(F.col("page_id") / block))
    n = written(n.select("doc", "page_id", "line_no", "block", "cut", "last", F.col("after.opening").alias("opening")), "page-turns")
    before = n.groupBy("doc", "block").agg(F.sum("cut").alias("cuts")).select("doc", "block", F.coalesce(F.sum("cuts").over(Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    own = F.coalesce(F.sum("cut").over(Window.partitionBy("doc", "block").orderBy("page_id", "line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = n.withColumn("own", own).join(before, ["doc", "block"]).select("doc", "page_id", "line_no", (F.col("own") + F.col("offset")).alias("paragraph_no"))
    together = parts.join(numbered, ["doc", "page_id", "line_no"]).groupBy("doc", "paragraph_no").agg(F.min("page_id").alias("first_page_id"), F.max("page_id").alias("last_page_id"), F.array_sort(F.collect_list(F.struct("page_id", "line_no", "word", "doubts"))).alias("parts"))
    # the first token of a page is a case only if it isn't the rest of one on the page before
    cut_off = (F.col("cut") == 0) & (F.length("last") > 1) & F.right("last", F.lit(1)).isin(*HYPHENS)
    turns = n.where("opening is not null").select(F.when(cut_off, F.expr("left(last, length(last) - 1)")).otherwise(F.col("opening")).alias("word"), F.when(cut_off, F.col("opening")).alias("rest"))
    firsts = parts.groupBy("doc").agg(F.min(F.struct("page_id", "line_no", "opening")).alias("p")).select(F.col("p.opening").alias("word"), F.lit(None).cast("string").alias("rest"))
    others = parts.select("line_no", F.explode("doubts").alias("d")).where("not (line_no = 0 and d.at = 0 and d.rest is null)").select("d.word", "d.rest")
    cases = others.unionByName(turns).unionByName(firsts)
    beside = df.sparkSession.sparkContext.broadcast(neighbours(pages, shared, doubtful_words(cases, shared)))

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, pairs = Vocabulary(shared.value), beside.value
        for b in batches:
            texts = []
            for ps in b.column("parts").to_pylist():
                out: list[str] = []
                open_cases: list[tuple] = []
                for p in ps:
                    ws = p["word"].split(" ")
                    doubts = {d["at"]: (d["word"], d["rest"], d["left"], d["after"], d["opens"]) for d in p["doubts"]}
                    if out and _is_open(out[-1]) and v.joins(out[-1][:-1], ws[0])[0]:
                        doubts[0] = (out.pop()[:-1], ws[0], "", ws[1] if len(ws) > 1 else "", False)
                    open_cases.extend((len(out) + at, *d) for at, d in sorted(doubts.items()))
                    out.extend(ws)
                stood = list(out)
                for at, word, rest, left, after, opens in open_cases:
                    sides = left or (stood[at - 1] if at else ""), after or (stood[at + 1] if at + 1 < len(stood) else "")
                    if rest is None:
                        out[at] = _mended(word, v.misread(word, *sides, pairs), opens)
                    else:
                        out[at] = _whole(word, rest, v.join(word, rest, *sides, pairs)[0])
                texts.append(" ".join(out))
            yield pa.RecordBatch.from_arrays([b.column("document_id"), b.column("paragraph_no"), b.column("first_page_id"), b.column("last_page_id"), pa.array(texts, pa.string())], names=["document_id", "paragraph_no", "first_page_id", "last_page_id", "text"])

    return together.withColumnRenamed("doc", "document_id").mapInArrow(glue, "document_id string, paragraph_no long, first_page_id long, last_page_id long, text string")
