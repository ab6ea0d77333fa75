import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.llm.levenshtein import Trie
from vellum.llm.scan import Vocabulary, fold, is_page_number, repaired_paragraphs, scan_faults, shape

PAGE = "document_id string, page_id long, metadata map<string,string>, raw string, doc string"
WORDS = "the cell moves along a gradient of stiffness in tissue and time-dependent waves modulate interface curvature while internal current fibre".split()


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@given(st.sets(st.text("abc", max_size=7), max_size=60), st.text("abcd", max_size=8), st.integers(0, 3))
def test_automaton_finds_all(words, pattern, k):
    assert Trie(words).within(pattern, k) == sorted((lev(pattern, w), w) for w in words if lev(pattern, w) <= k)


def test_fold_and_right():
    v = Vocabulary({w: 1 for w in WORDS})
    for wrong, right in (("rnoves", "moves"), ("interfäce", "interface"), ("curvatiire", "curvature"), ("lnternal", "internal"), ("interrial", "internal"), ("cuffent", None), ("gradlent", "gradient"), ("ce11", "cell"), ("5tiffness", "stiffness"), ("ciirrent", "current")):
        assert v.right(wrong) == right, wrong
    assert fold("modern") == fold("modem")
    for token in ("cell", "Cell,", "QCF-24", "15", "l5", "3.25", "", "ﬁbre", "xbk8"):
        assert v.misread(token) is None, token
    assert v.join("curva", "ture,") == ("curvature", False) and v.join("time", "dependent") == ("time-dependent", False) and v.join("curva", "tiire") == ("curvature", True) and v.join("xx", "yy") is None


def test_context_ranks_candidates():
    v = Vocabulary({"form": 5, "farm": 5, "the": 9})
    # as near to one as to the other
    assert v.candidates("fxrm") == [] and Vocabulary({"formation": 1, "farmation": 9}).right("fxrmation") == "farmation"
    w = Vocabulary({"formation": 1, "farmation": 9})
    assert w.right("fxrmation", "the", "", {("the", "formation"): 3}) == "formation"


def test_candidates_beside_an_equal_folded_spelling():
    v = Vocabulary({"near": 9, "local": 1, "unclear": 1, "under": 9})
    # 'lical' is 'near' in strokes, but one letter from 'local'
    assert v.candidates("lical") == [(0, "near"), (1, "local")] and v.right("lical") == "local"
    assert v.candidates("undear") == [(0, "unclear"), (1, "under")] and v.right("undear") == "unclear"


def test_page_numbers():
    for yes in ("12", "- 7 -", "[111]", "Page 3 of 16", "xiii", "l38", "36l", "p. 4", "Page 3 0f 16"):
        assert is_page_number(yes), yes
    for no in ("(26)", "Eq. 12", "cell", "", "7. Methods", "3.2", "iiii"):
        assert not is_page_number(no), no
    assert shape("Anna1s of Living Fluids 36") == shape("12  Annals 0f Living Fluids 9")


P1 = "Notes in Cells 4\nThe cell moves along a gra-\ndient of stiffness. The interfäce\r\n\n(12)\n\nmodulate the curva-\n- 1 -"
P2 = "Notes in Ce11s 4\nture of tissue while rnoves\nalong a time-\n- 2 -"
P3 = "dependent waves.\n\nMethods\nthe cell 15\n- 3 -"


def lexicon(spark):
    return spark.createDataFrame([(w, 5) for w in WORDS] + [("methods", None), (None, 3)], "word string, freq long")


def test_faults(spark):
    pages = [("d", 1, {"title": "x"}, P1, "e"), ("d", 1, {"title": "x"}, P1, "e"), ("d", 2, None, P2, "e"), ("d", 4, None, "  ", "e"), ("d", 3, None, P3, "e"), ("d", 5, None, None, "e"), ("d", None, None, P1, "e"), (None, 9, None, "open-", "e")]
    got = rows(scan_faults(spark.createDataFrame(pages, PAGE), F.col("raw"), lexicon(spark)))
    assert got == sorted(
        [
            (1, 1, "furniture", ""),
            (1, 8, "furniture", ""),
            (2, 1, "furniture", ""),
            (2, 4, "furniture", ""),
            (3, 5, "furniture", ""),
            (1, 2, "hyphen", "gradient"),
            (1, 7, "hyphen", "curvature"),
            (2, 3, "hyphen", "time-dependent"),
            (1, 3, "misread", "interface"),
            (2, 2, "misread", "moves"),
        ],
        key=repr,
    )
    empty = spark.createDataFrame([], PAGE)
    assert scan_faults(empty, F.col("raw"), lexicon(spark)).count() == 0
    only = scan_faults(spark.createDataFrame(pages, PAGE), F.col("raw"), lexicon(spark).where("1 = 0"))
    assert {r.fault for r in only.collect()} == {"furniture"}


def test_first_word_misread_without_open_word(spark):
    pages = [("d", 1, None, "the cell moves.", ""), ("d", 2, None, "curvatiire of tissue", "")]
    assert rows(scan_faults(spark.createDataFrame(pages, PAGE), F.col("raw"), lexicon(spark))) == [(2, 1, "misread", "curvature")]


def test_paragraphs(spark):
    pages = [("d", 1, None, P1, ""), ("d", 2, None, P2, ""), ("d", 3, None, P3, "")]
    got = [tuple(r) for r in repaired_paragraphs(spark.createDataFrame(pages, PAGE), F.col("raw"), lexicon(spark)).orderBy("paragraph_no").collect()]
    assert got == [
        ("d", 0, 1, 1, "The cell moves along a gradient of stiffness. The interface"),
        ("d", 1, 1, 1, "(12)"),
        ("d", 2, 1, 3, "modulate the curvature of tissue while moves along a time-dependent waves."),
        ("d", 3, 3, 3, "Methods the cell 15"),
    ]


def test_blocks_of_pages(spark):
    """A document is not walked as one: its pages meet across the borders of blocks."""
    rnd = random.Random(1)
    pages = [("d", i * 1500, None, " ".join(rnd.sample(WORDS, 6)) + " curva-", "") for i in range(12)]
    pages = [(d, p, m, ("ture " if p else "") + t, x) for d, p, m, t, x in pages]
    got = rows(scan_faults(spark.createDataFrame(pages, PAGE), F.col("raw"), lexicon(spark)))
    assert got == [(i * 1500, 1, "hyphen", "curvature") for i in sorted(range(11), key=lambda i: repr((i * 1500, 1, "hyphen", "curvature")))]
    assert repaired_paragraphs(spark.createDataFrame(pages, PAGE), F.col("raw"), lexicon(spark)).count() == 1


def test_long_page(spark):
    text = "\n".join("the cell moves along a gradient of stiffness" for _ in range(4000))
    got = scan_faults(spark.createDataFrame([("d", 1, None, text, "")], PAGE), F.col("raw"), lexicon(spark))
    assert got.count() == 0


def test_neighbours_decide_between_equals(spark):
    words = spark.createDataFrame([("lone", 1), ("rone", 9), ("the", 1), ("old", 1), ("wave", 1)], "word string, freq long")
    pages = [("d", i, None, "wave the lone wave old rone wave", "") for i in range(5)] + [("e", 90, None, "wave the 1one wave\nwave old 1one wave", "")]
    got = rows(scan_faults(spark.createDataFrame(pages, PAGE).where("page_id < 1 or page_id > 4"), F.col("raw"), words))
    assert [r for r in got if r[0] == 90] == [(90, 1, "misread", "lone"), (90, 2, "misread", "rone")]


def test_neighbours_across_line_ends_decide(spark):
    words = spark.createDataFrame([("lone", 1), ("rone", 9), ("the", 1), ("old", 1), ("wave", 1)], "word string, freq long")
    page = "wave the lone wave old rone wave\nwave the\n1one\nwave wave the lo-\nne wave"
    got = rows(scan_faults(spark.createDataFrame([("e", 90, None, page, "")], PAGE), F.col("raw"), words))
    assert got == [(90, 3, "misread", "lone"), (90, 4, "hyphen", "lone")]
    cut = "wave the lone wave old rone wave\nwave the 1o-\nne wave"
    for text, word in ((cut, "lone"), (cut.replace("the 1o", "old 1o"), "rone")):
        df = spark.createDataFrame([("e", 90, None, text, "")], PAGE)
        assert {r for r in rows(scan_faults(df, F.col("raw"), words)) if r[2] == "hyphen"} == {(90, 2, "hyphen", word)}
        assert f" {word} wave" in repaired_paragraphs(df, F.col("raw"), words).first().text.split("wave wave")[1]


def test_every_word_meets_the_automaton():
    v = Vocabulary({w: 1 for w in WORDS})
    met, within = [], v.trie.within
    v.trie.within = lambda f, k: met.append((f, k)) or within(f, k)
    words = ("ce11", "interfäce", "gradlent", "xbk8", "tbe")
    assert [v.misread(w) for w in words] == ["cell", "interface", "gradient", None, "the"]
    assert [f for f, _ in met] == [fold(w) for w in words] and all(k for _, k in met)


def test_neighbours_decide_between_unequal_strokes(spark):
    words = spark.createDataFrame([("formation", 1), ("farmation", 9), ("the", 1), ("old", 1), ("wave", 1)], "word string, freq long")
    page = "wave the formation wave old farmation wave.\nold wave the fxrmation wave old fxrmation\nwave the fxr-\nmation wave."
    df = spark.createDataFrame([("e", 90, None, page, "")], PAGE)
    assert rows(scan_faults(df, F.col("raw"), words)) == sorted([(90, 2, "misread", "formation"), (90, 2, "misread", "farmation"), (90, 3, "hyphen", "formation"), (90, 3, "misread", "formation")], key=repr)
    assert repaired_paragraphs(df, F.col("raw"), words).first().text == "wave the formation wave old farmation wave. old wave the formation wave old farmation wave the formation wave."


def test_neighbours_across_page_ends_decide(spark):
    words = spark.createDataFrame([("lone", 1), ("rone", 9), ("the", 1), ("old", 1), ("wave", 1), ("flow", 1)], "word string, freq long")
    # page 2 begins, and page 3 ends, with a word whose neighbour is on the other page; a word is cut after page 4; page 6 is the first of another document
    texts = ["the lone flow wave old rone wave old\nwave wave the", "1one the\nwave wave", "wave flow\nwave 1one", "flow wave\nwave the 1o-", "ne the wave\nflow wave."]
    pages = [("e", i + 1, None, t, "") for i, t in enumerate(texts)] + [("f", 6, None, "1one flow wave\nwave flow old.", "")]
    df = spark.createDataFrame(pages, PAGE)
    assert rows(scan_faults(df, F.col("raw"), words)) == sorted([(2, 1, "misread", "lone"), (3, 2, "misread", "lone"), (4, 2, "hyphen", "lone"), (4, 2, "misread", "lone"), (6, 1, "misread", "lone")], key=repr)
    got = [r.text for r in repaired_paragraphs(df, F.col("raw"), words).orderBy("document_id").collect()]
    assert got == ["the lone flow wave old rone wave old wave wave the lone the wave wave wave flow wave lone flow wave wave the lone the wave flow wave.", "lone flow wave wave flow old."]
