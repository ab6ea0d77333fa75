"""Section types of headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import normalize_heading

# Names of sections by type, as whole normalised headings.
NAMES = {
    "references": ("references", "reference", "bibliography", "works cited", "literature cited"),
    "further_reading": (
        "further reading",
        "further readings",
        "recommended reading",
        "recommended readings",
        "suggested reading",
        "suggested readings",
        "additional reading",
        "additional readings",
        "further reading and listening",
    ),
    "acknowledgments": ("acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements"),
    "abstract": ("abstract", "summary"),
    "introduction": ("introduction", "background"),
    "methods": ("methods", "methodology", "materials and methods", "methods and materials", "experimental methods", "experimental procedures", "experimental section"),
    "results": ("results",),
    "discussion": ("discussion",),
    "conclusion": ("conclusion", "conclusions", "concluding remarks", "concluding discussion"),
    "supplementary": ("appendix", "appendices"),
    "frontmatter": (
        "contents",
        "table of contents",
        "preface",
        "foreword",
        "prologue",
        "introduction to the book",
        "about the author",
        "about the authors",
        "contributors",
        "list of contributors",
        "dedication",
        "title page",
        "copyright page",
    ),
    "index": ("index", "subject index", "author index", "name index", "general index"),
    "notes": ("notes", "endnotes", "chapter notes", "notes to chapters"),
    "glossary": ("glossary", "glossary of terms"),
}
# How headings of a type may begin, and what those of the supplement hold.
BEGINNINGS = {"references": "references and", "results": "results ", "discussion": "discussion ", "supplementary": "appendix "}
SUPPLEMENT = ("supplementary material", "supplemental material", "supplementary information", "supporting information")
# Types that headings below one take over.
INHERITED = ("abstract", "introduction", "methods", "results", "discussion", "conclusion", "supplementary", "references", "acknowledgments", "index", "notes", "glossary", "further_reading")
# Types that are searched.
SEARCHABLE = ("abstract", "introduction", "methods", "results", "discussion", "conclusion", "body", "sidebar", "caption", "supplementary")


def heading_type(heading: Column) -> Column:
    """[TXT8] The section type of a heading; 'body' where no rule holds, also for null."""
    h, out = normalize_heading(heading), F.lit(None).cast("string")
    for kind, names in NAMES.items():
        rule = h.isin(*names)
        if kind in BEGINNINGS:
            rule = rule | h.startswith(BEGINNINGS[kind])
        if kind == "supplementary":
            for phrase in SUPPLEMENT:
                rule = rule | h.contains(phrase)
        out = F.coalesce(out, F.when(rule, kind))
    return F.coalesce(out, F.lit("body"))


def is_searchable(chunk_type: Column, types: tuple[str, ...] = SEARCHABLE) -> Column:
    """[FIL1] Of a searched type; reaches the scan as a pushed filter. Null is not."""
    return chunk_type.isin(*types)
