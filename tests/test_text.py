import hashlib

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.headings import heading_type
from vellum.functions.paths import hash_set, path_key


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'array<int>' if k == 'span' else 'array<string>' if k == 'segs' else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize("span,want", [([0, 3], "abc"), ([2, 99], "cdef"), (None, ""), ([3, 1], ""), ([-1, 2], ""), ([9, 12], ""), ([1], ""), ([1, 2, 3], ""), ([1, 1], "")])
def test_box_text(spark, span, want):
    assert one(spark, T.box_text(F.col("raw"), F.col("span")), raw="abcdef", span=span) == want


@pytest.mark.parametrize("segs,want", [(["phenom-", "enon is"], "phenomenon is"), (["end-", "Next"], "end-\n\nNext"), (["a", "", None, "b"], "a\n\nb"), ([], ""), (None, "")])
def test_join_segments(spark, segs, want):
    assert one(spark, T.join_segments(F.col("segs")), segs=segs) == want


def test_normalize(spark):
    assert one(spark, T.normalize(F.col("x")), x="a\xa0\xadb�\t\tc\r\n\r\n\r\nd\re ") == "a b c\n\nd\ne"
    assert one(spark, T.normalize(F.col("x")), x=None) == ""


@pytest.mark.parametrize(
    "heading,kind",
    [("## Results", "results"), ("Results and Discussion", "results"), ("1. Introduction", "body"), ("**Materials and Methods**", "methods"), ("Appendix A", "supplementary"), ("Supporting Information for", "supplementary"), ("Index", "index"), ("Chapter 3", "body"), ("References and Notes", "references"), ("<b>Summary</b>", "abstract"), (None, "body"), ("", "body")],
)
def test_heading_type(spark, heading, kind):
    assert one(spark, heading_type(F.col("x")), x=heading) == kind


def test_terms_and_anchors(spark):
    q = "How does IL-6 or p53 control SMARCA2 and tissue tissue shape?"
    terms = one(spark, T.query_terms(F.col("x")), x=q)
    assert terms == ["il-6", "control", "smarca2", "tissue", "shape"]
    assert one(spark, T.anchor_terms(T.query_terms(F.col("x"))), x=q) == ["il-6", "smarca2"]


def test_citations(spark):
    assert one(spark, T.source_ids(F.col("x")), x="a [S2][S4] b [S2] [S1, S2]") == ["S2", "S4"]
    for tail, want in (("... [S", True), ("[S12", True), ("[S2]", False), ("", False)):
        assert one(spark, T.has_incomplete_citation(F.col("x")), x=tail) is want
    assert one(spark, T.remove_citations(F.col("x")), x="- The cell [S1]  moves.") == "The cell moves."
    assert one(spark, T.is_substantive(F.col("x")), x="one two three four five six seven [S1]") is False
    assert one(spark, T.is_substantive(F.col("x")), x="one two three four five six seven eight") is True


def test_numbers_labels_ids(spark):
    assert [one(spark, T.safe_double(F.col("x"), 7.0), x=v) for v in ("1.5", "nan", "x", None)] == [1.5, 7.0, 7.0, 7.0]
    assert one(spark, T.citation_label(F.col("f"), F.lit(2), F.lit(2)), f="a.pdf") == "[a.pdf, p. 2]"
    assert one(spark, T.citation_label(F.col("f"), F.lit(2), F.lit(4)), f="a.pdf") == "[a.pdf, pp. 2-4]"
    assert one(spark, T.stable_id([F.col("x"), F.lit("2")]), x="é") == hashlib.sha256("é|2".encode()).hexdigest()[:24]
    assert one(spark, T.preview(F.col("x"), 3), x="abcd") == "abc..."
    assert one(spark, T.count_tokens(F.col("x")), x="It's 3.5 µm_") == 8
    assert one(spark, T.count_tokens(F.col("x")), x=None) == 0


@pytest.mark.parametrize("kind,section,want", [("Caption", None, True), ("body", "Fig. 3", True), ("body", "Figures", False), (None, "table: x", True), (None, None, False)])
def test_caption_like(spark, kind, section, want):
    assert one(spark, T.caption_like(F.col("k"), F.col("s")), k=kind, s=section) is want


def test_lowercase_and_metadata(spark):
    assert one(spark, T.starts_with_lowercase(F.col("x")), x="(3) enon") is True
    assert one(spark, T.starts_with_lowercase(F.col("x")), x="12") is False
    assert one(spark, T.looks_like_metadata(F.col("x")), x="ISSN 1234") is True
    assert one(spark, T.looks_like_metadata(F.col("x")), x=None) is False


def test_paths(spark):
    assert one(spark, path_key(F.col("x")), x="C:\\A\\Café") == "c:/a/café"
    assert one(spark, path_key(F.col("x")), x=None) is None
    assert one(spark, hash_set(F.col("segs")), segs=["B", "a", None, "b"]) == ["a", "b"]
    assert one(spark, hash_set(F.col("segs")), segs=None) == []
