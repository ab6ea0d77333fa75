"""Cutting long texts at natural boundaries, with overlap.

Lexical cohesion decides between boundaries of one kind: the similarity of the
words before and after each boundary is taken over sliding blocks, and within
a size window the cut goes to the deepest valley.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of letters or digits, or any other single character that is not white space.
TOKEN = re.compile(r"[^\W_]+|\S")
BLANK_LINE = re.compile(r"\n(?:[^\S\n]*\n)+")
SENTENCE_END = re.compile(r"[.!?](?=\s+[A-Z])")
# After these a full stop ends no sentence.
ABBREVIATIONS = ("Fig", "Figs", "Eq", "Eqs", "Ref", "Refs", "al", "cf", "vs", "ca", "approx")
ABBREVIATION = re.compile(r"(?<![^\W_])(?:" + "|".join(ABBREVIATIONS) + r")$")
LEVELS = ("paragraph", "sentence", "word", "none")


class Layout:
    """Tokens of a text and, for the place before each token, the kind of boundary there."""

    def __init__(self, text: str):
        spans = [m.span() for m in TOKEN.finditer(text)]
        self.text, self.n = text, len(spans)
        self.start = np.fromiter((s for s, _ in spans), "i8", self.n)
        self.end = np.fromiter((e for _, e in spans), "i8", self.n)
        # level[i]: of a cut before token i; 3 within a run without white space
        self.level = np.full(self.n + 1, 3, "i1")
        gap = np.zeros(self.n + 1, bool)
        gap[1 : self.n] = self.start[1:] > self.end[:-1]
        self.level[gap] = 2
        for m in SENTENCE_END.finditer(text):
            if text[m.start()] != "." or not ABBREVIATION.search(text, max(0, m.start() - 8), m.start()):
                self.level[np.searchsorted(self.start, m.end())] = 1
        for m in BLANK_LINE.finditer(text):
            self.level[np.searchsorted(self.start, m.end())] = 0
        self.level[[0, self.n]] = 0

    def boundary(self, limit: int) -> str:
        """The coarsest kind of unit of which none exceeds ``limit`` tokens."""
        for i, name in enumerate(LEVELS[:3]):
            if np.diff(np.flatnonzero(self.level <= i)).max(initial=0) <= limit:
                return name
        return "none"

    def depths(self, block: int) -> np.ndarray:
        """How deep the valley of lexical cohesion is at each paragraph or sentence boundary; -1 elsewhere."""
        depth = np.full(self.n + 1, -1.0)
        gaps = np.flatnonzero(self.level[1 : self.n] <= 1) + 1
        if not len(gaps):
            return depth
        ids: dict[str, int] = {}
        word = np.fromiter((ids.setdefault(t, len(ids)) if len(t := self.text[s:e].lower()) > 3 else -1 for s, e in zip(self.start, self.end)), "i8", self.n)
        sim = np.empty(len(gaps))
        for k, g in enumerate(gaps):
            left, right = word[max(0, g - block) : g], word[g : g + block]
            a, ca = np.unique(left[left >= 0], return_counts=True)
            b, cb = np.unique(right[right >= 0], return_counts=True)
            _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            norm = np.sqrt(float((ca * ca).sum()) * float((cb * cb).sum()))
            sim[k] = float((ca[i] * cb[j]).sum()) / norm if norm else 0.0
        for k in range(len(gaps)):
            lo = hi = k
            while lo > 0 and sim[lo - 1] >= sim[lo]:
                lo -= 1
            while hi + 1 < len(gaps) and sim[hi + 1] >= sim[hi]:
                hi += 1
            depth[gaps[k]] = sim[lo] + sim[hi] - 2 * sim[k]
        return depth

    def pieces(self, limit: int, overlap: int, block: int) -> list[tuple[int, int, str]]:
        """``(first token, end token, kind of the cut at the end)`` of each piece."""
        out, s, depth = [], 0, self.depths(block)
        while self.n - s > limit:
            lo, mid, hi = s + overlap + 1, s + max(overlap + 1, limit // 2), s + limit
            for level in (0, 1, 2, 3):
                # the later half of the window first, so that pieces don't get small without need
                at = np.array([], "i8")
                for a, b in ((mid, hi), (lo, mid - 1)):
                    at = a + np.flatnonzero(self.level[a : b + 1] == level)
                    if len(at):
                        break
                if len(at):
                    break
            cut = int(at[-1]) if level > 1 else int(at[np.lexsort((at, depth[at]))[-1]])
            out.append((s, cut, LEVELS[level]))
            s = cut - overlap
        return [*out, (s, self.n, "end")]


def _oversized(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # counts no-break spaces as tokens: never too few
            b = b.filter(pc.greater(pc.count_substring_regex(b.column("text"), r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), limit))
            long = [sum(1 for _ in TOKEN.finditer(t)) > limit for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(long, pa.bool_()))

    return run


def split_oversized(df: DataFrame, kind: Column, item_id: Column, text: Column, *, limit: int = 700, overlap: int = 100, block: int = 100) -> DataFrame:
    """Pieces of at most ``limit`` tokens of each text above it.

    Columns ``item_kind, item_id, boundary, piece_no, first_token, start_char,
    end_char, n_tokens, cut, text``. A piece ends at a paragraph, else a
    sentence, else a word in reach, else anywhere between tokens, and the next
    begins ``overlap`` tokens before that end. ``boundary`` is the coarsest
    kind of unit of which the whole text has none above the limit. Texts up to the limit, null or
    empty ones and rows without id give nothing. Repeated rows of one id count
    once, the greatest text if they differ.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    source = df.select(kind.alias("item_kind"), item_id.cast("string").alias("item_id"), text.alias("text")).where(F.col("item_id").isNotNull() & (F.length("text") > limit))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                lay = Layout(row["text"])
                kind_of_all = lay.boundary(limit)
                found = lay.pieces(limit, overlap, block)
                spans = [(int(lay.start[s]), int(lay.end[e - 1])) for s, e, _ in found]
                n = len(found)
                yield pa.RecordBatch.from_pydict(
                    {
                        "item_kind": [row["item_kind"]] * n,
                        "item_id": [row["item_id"]] * n,
                        "boundary": [kind_of_all] * n,
                        "piece_no": list(range(n)),
                        "first_token": [s for s, _, _ in found],
                        "start_char": [a for a, _ in spans],
                        "end_char": [z for _, z in spans],
                        "n_tokens": [e - s for s, e, _ in found],
                        "cut": [c for _, _, c in found],
                        "text": [row["text"][a:z] for a, z in spans],
                    },
                    schema=_PIECES,
                )

    once = source.mapInArrow(_oversized(limit), source.schema).groupBy("item_kind", "item_id").agg(F.max("text").alias("text"))
    return once.mapInArrow(cut, "item_kind string, item_id string, boundary string, piece_no int, first_token int, start_char int, end_char int, n_tokens int, cut string, text string")


_PIECES = pa.schema([("item_kind", pa.string()), ("item_id", pa.string()), ("boundary", pa.string()), *[(c, pa.int32()) for c in ("piece_no", "first_token", "start_char", "end_char", "n_tokens")], ("cut", pa.string()), ("text", pa.string())])
