import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.llm.split import TOKEN, Layout, split_oversized


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab. \nA!,é"), max_size=260), st.integers(4, 20), st.integers(0, 1))
def test_pieces_cover_the_text(text, limit, overlap):
    lay = Layout(text)
    found = lay.pieces(limit, overlap, 10)
    assert found[0][0] == 0 and found[-1][1] == lay.n
    for (a, b, cut), (c, _, _) in zip(found, found[1:]):
        assert c == b - overlap and a + overlap < b <= a + limit
        level = ("paragraph", "sentence", "word", "none").index(cut)
        # no coarser boundary was in reach
        assert lay.level[b] == level and (lay.level[a + overlap + 1 : a + limit + 1] >= level).all()
    assert found[-1][1] - found[-1][0] <= max(limit, lay.n if lay.n <= limit else limit)


def unit(words):
    return " ".join(words)


def test_boundary_kinds():
    w = [f"w{i}" for i in range(12)]
    assert Layout(unit(w[:6]) + "\n \n" + unit(w[6:])).boundary(6) == "paragraph"
    assert Layout(unit(w[:5]) + ". " + unit(w[6:11]).capitalize() + ".").boundary(6) == "sentence"
    assert Layout(unit(w[:5]) + " Fig. " + unit(w[6:10]).capitalize() + ".").boundary(7) == "word"
    assert Layout(unit(w[:5]) + " xFig. " + unit(w[6:10]).capitalize() + ".").boundary(7) == "sentence"
    assert Layout(unit(w) + " a.b.c.d.e").boundary(6) == "none"
    assert Layout("a_b c").n == 4


def test_deepest_valley_is_taken():
    topic = ["membrane stretches under tension. ", "Waves travel through neuronal circuits. "]
    text = (topic[0].capitalize() * 6) + (topic[1] * 6)
    lay = Layout(text)
    cut = lay.pieces(45, 5, 20)[0][1]
    assert text[: lay.end[cut - 1]].count("membrane".capitalize()) == 6 and "Waves" not in text[: lay.end[cut - 1]]


def test_operator(spark):
    long = "One two three four five six seven. " * 200
    data = [("chunk", "a", long, 1), ("chunk", "a", long, 1), ("page", "a", "x" * 5000, 1), ("chunk", "b", "short", 1), ("chunk", "c", None, 1), ("chunk", "d", "", 1), ("chunk", None, long, 1), ("chunk", "e", "ab, " * 400, 1)]
    df = spark.createDataFrame(data, "kind string, id string, text string, piece_no int")
    got = split_oversized(df, F.col("kind"), F.col("id"), F.col("text")).orderBy("item_kind", "item_id", "piece_no").collect()
    assert {(r.item_kind, r.item_id, r.boundary) for r in got} == {("chunk", "a", "sentence"), ("chunk", "e", "word")}
    for i in ("a", "e"):
        ps, text = [r for r in got if r.item_id == i], long if i == "a" else "ab, " * 400
        assert all(len(TOKEN.findall(r.text)) == r.n_tokens <= 700 and text[r.start_char : r.end_char] == r.text for r in ps)
        for p, q in zip(ps, ps[1:]):
            assert TOKEN.findall(p.text)[-100:] == TOKEN.findall(q.text)[:100]
        # an exact round trip: new tokens of each piece, in order
        tokens = [t for k, r in enumerate(ps) for t in TOKEN.findall(r.text)[100 * (k > 0) :]]
        assert tokens == TOKEN.findall(text)
    assert split_oversized(df.where("1 = 0"), F.col("kind"), F.col("id"), F.col("text")).count() == 0


def test_no_white_space_at_all(spark):
    df = spark.createDataFrame([("k", "1", "a." * 900)], "kind string, id string, text string")
    assert rows(split_oversized(df, F.col("kind"), F.col("id"), F.col("text")), "boundary", "cut", "n_tokens")[0] == ("none", "end", 600)
    assert re.fullmatch("none", "none")
