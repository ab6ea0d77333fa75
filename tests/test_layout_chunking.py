import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.functions.text import count_tokens
from vellum.operators.chunking import ChunkSizes, assemble_chunks, chunk_statistics, segments, split_long
from vellum.operators.layout import document_blocks, layout_clean, markdown_units, repair_interrupted

PAGE = "document_id string, title string, page_order long, page_number int, text string, captions array<string>"
BLOCK = "document_id string, page_order long, pos int, text string, page_number int, section string, chunk_type string, is_heading boolean, level int"


def test_layout_clean(spark):
    raw = "HEAD body one. Fig cap more-" + "x" * 0
    boxes = [(2, "caption", [15, 22]), (1, "text", [5, 14]), (0, "page-header", [0, 4]), (3, "picture", [0, 28]), (4, "text", [23, 99]), (5, "text", None)]
    df = spark.createDataFrame([(raw, boxes), (raw, None), (raw, []), (None, boxes), ("y" * 250, [(0, "text", [0, 10])])], "raw string, b array<struct<box_index:int,box_class:string,char_span:array<int>>>")
    got = [(r.c.body, r.c.captions) for r in df.select(layout_clean(F.col("raw"), F.col("b")).alias("c")).collect()]
    assert got == [("body one.\n\nmore-", ["Fig cap"]), (raw, []), (raw, []), ("", []), ("y" * 250, [])]


def test_markdown_units(spark):
    text = "Intro line\nsecond line\n# Top **x**\nafter\r\n\r\n\n### Low\n#NoHeading\n\n"
    u = spark.createDataFrame([(text,), (None,), ("  ",)], "t string").select(markdown_units(F.col("t")).alias("u")).collect()
    assert [(x.kind, x.text, x.level) for x in u[0].u] == [("paragraph", "Intro line second line", None), ("heading", "Top x", 1), ("paragraph", "after", None), ("heading", "Low", 3), ("paragraph", "#NoHeading", None)]
    assert u[1].u == [] and u[2].u == []


def test_blocks_carry_sections_and_inherit(spark):
    pages = [
        ("d", "T", 1, 1, "lead\n\n# Results\n\npara\n\n### Detail\n\nmore", ["A cap", " "]),
        ("d", "T", 2, 2, "goes on\n\n# Preface\n\n## Inner\n\nx\n\n# 1. Introduction\n\ny", None),
        ("d", "T", 3, 3, "all rights reserved\n\nISSN 1\n\nplain", None),
        ("e", None, 1, 1, "only", None),
        ("f", "", 1, 1, None, None),
    ]
    b = document_blocks(spark.createDataFrame(pages, PAGE))
    got = [tuple(r) for r in b.orderBy("document_id", "page_order", "pos").select("document_id", "page_order", "text", "section", "chunk_type", "is_heading").collect()]
    assert got == [
        ("d", 1, "lead", "T", "body", False),
        ("d", 1, "Results", "Results", "results", True),
        ("d", 1, "para", "Results", "results", False),
        ("d", 1, "Detail", "Detail", "results", True),
        ("d", 1, "more", "Detail", "results", False),
        ("d", 1, "A cap", "Figure / Table Caption", "caption", False),
        ("d", 2, "goes on", "Detail", "results", False),
        ("d", 2, "Preface", "Preface", "frontmatter", True),
        ("d", 2, "Inner", "Inner", "body", True),
        ("d", 2, "x", "Inner", "body", False),
        ("d", 2, "1. Introduction", "1. Introduction", "body", True),
        ("d", 2, "y", "1. Introduction", "body", False),
        ("d", 3, "all rights reserved", "1. Introduction", "metadata", False),
        ("d", 3, "ISSN 1", "1. Introduction", "metadata", False),
        ("d", 3, "plain", "1. Introduction", "metadata", False),
        ("e", 1, "only", "Main text", "body", False),
    ]


def test_sections_carry_over_blocks_of_pages(spark):
    pages = [("d", "T", i * 5000, i, "# Results\n\nx" if i == 1 else f"p{i}", None) for i in range(5)]
    b = document_blocks(spark.createDataFrame(pages, PAGE))
    assert [r.section for r in b.orderBy("page_order", "pos").collect()] == ["T", "Results", "Results", "Results", "Results", "Results"]
    chunks = assemble_chunks(segments(b), spark.createDataFrame([("d", "s")], "document_id string, sha256 string"))
    assert [(r.chunk_index, r.text) for r in chunks.orderBy("chunk_index").collect()] == [(0, "p0"), (1, "x"), (2, "p2"), (3, "p3"), (4, "p4")]
    wide = assemble_chunks(segments(b), spark.createDataFrame([("d", "s")], "document_id string, sha256 string"), ChunkSizes(cross_page=True))
    assert [(r.chunk_index, r.text, r.page_start, r.page_end) for r in wide.orderBy("chunk_index").collect()] == [(0, "p0", 0, 0), (1, "x\n\np2\n\np3\n\np4", 1, 4)]


def block(pos, text, heading=False, section="S", kind="body", page=1):
    return ("d", page, pos, text, page, section, kind, heading, 2 if heading else None)


def test_interrupted_layout(spark):
    b = [block(0, "observed phenom-"), block(1, "Box", True, "Box", "body"), block(2, "side text", section="Box"), block(3, "enon is driven", section="Box"), block(4, "then", section="Box"), block(5, "New", True, "New"), block(6, "z", section="New")]
    got = [tuple(r) for r in repair_interrupted(spark.createDataFrame(b, BLOCK)).orderBy("pos").select("text", "section", "chunk_type", "is_heading").collect()]
    assert got == [("observed phenomenon is driven", "S", "body", False), ("Box\n\nside text", "Box", "sidebar", False), ("then", "S", "body", False), ("New", "New", "body", True), ("z", "New", "body", False)]
    # two cases that share a block: the earlier is taken
    chain = [block(0, "a-"), block(1, "H", True, "H"), block(2, "s", section="H"), block(3, "b-", section="H"), block(4, "K", True, "K"), block(5, "t", section="K"), block(6, "c", section="K")]
    got = [r.text for r in repair_interrupted(spark.createDataFrame(chain, BLOCK)).orderBy("pos").collect()]
    assert got == ["ab-", "H\n\ns", "K", "t", "c"]
    assert repair_interrupted(spark.createDataFrame([], BLOCK)).count() == 0


def test_split_long(spark):
    sizes = ChunkSizes(target=10, overlap=3, least=4, most=12)
    sentence = "One two three four five. "
    long = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(sentence * 4,), (long,), ("short",), (None,), (sentence + long.capitalize() + ". " + sentence,)], "t string").select(split_long(F.col("t"), sizes).alias("s"))
    a, b, c, d, e = [r.s for r in df.collect()]
    assert a == ["One two three four five."] * 4
    assert [x.split()[0] for x in b] == ["w0", "w7", "w14", "w21"] and all(len(x.split()) <= 10 for x in b)
    assert c == ["short"] and (d is None or d == [None])
    assert e[0] == "One two three four five." and e[-1] == "One two three four five."


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["S", "T"]), st.integers(1, 14)), min_size=1, max_size=12))
def test_chunks_keep_to_one_section(spark, blocks):
    sizes = ChunkSizes(target=10, overlap=3, least=4, most=12)
    b = [block(i, " ".join(f"{s}{i}x{j}" for j in range(n)), section=s, page=1 + i // 5) for i, (s, n) in enumerate(blocks)]
    chunks = assemble_chunks(segments(spark.createDataFrame(b, BLOCK), sizes), spark.createDataFrame([("d", "sha")], "document_id string, sha256 string"), sizes).collect()
    for c in chunks:
        assert c.text.strip() and all(w[0] == c.section for w in c.text.split()) and c.page_start == c.page_end
    assert {w for c in chunks for w in c.text.split()} == {w for x in b for w in x[3].split()}
    assert sorted(c.chunk_index for c in chunks) == list(range(len(chunks)))


def test_chunk_overlap(spark):
    sizes = ChunkSizes(target=10, overlap=3, least=4, most=12)
    b = [block(0, "a1 a2 a3 a4 a5 a6"), block(1, "b1 b2"), block(2, "c1 c2 c3 c4 c5")]
    got = assemble_chunks(segments(spark.createDataFrame(b, BLOCK), sizes), spark.createDataFrame([("d", None)], "document_id string, sha256 string"), sizes).orderBy("chunk_index").collect()
    assert [c.text for c in got] == ["a1 a2 a3 a4 a5 a6\n\nb1 b2", "a6\n\nb1 b2\n\nc1 c2 c3 c4 c5"]
    assert rows(chunk_statistics(spark.createDataFrame([], "token_count int"))) == [(0, 0, 0, 0, 0.0, 0, 0)]


def test_sizes_are_checked():
    for bad in ({"least": 600}, {"overlap": 550}, {"target": 800}):
        with pytest.raises(ValueError):
            ChunkSizes(**bad)
