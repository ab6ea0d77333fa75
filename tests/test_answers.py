import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.operators.answers import claim_prompts, claims, finished_cleanly, outcomes, parse_gate, prune, render_citations, renumbered, repair_feedback, support_check, verification_batches, verify_citations

ANSWER = (
    "Cells move along gradients of stiffness in the tissue. However, this model explains the flow [S1]. It is short.\n\n"
    "- These results hold for all of the waves [S2][S1].\n* Thus, the last one is not backed by anything [S9]."
)


@pytest.fixture(scope="module")
def data(spark):
    a = spark.createDataFrame([(1, ANSWER), (2, "Nothing is cited [S1, S2] here."), (3, None), (4, "All good [S1].")], "query_id int, answer string")
    e = spark.createDataFrame([(1, "S1", "one [S2].pdf", 1, 2, "first"), (1, "S2", "b.pdf", 3, 3, "second"), (4, "S1", "c.pdf", 1, 1, "third")], "query_id int, source_id string, filename string, page_start int, page_end int, text string")
    return a, e


def test_citations(data):
    a, e = data
    assert rows(verify_citations(a, e)) == [(1, ["S1", "S2", "S9"], ["S9"], True, False), (2, [], [], False, False), (3, [], [], False, False), (4, ["S1"], [], True, True)]
    shown = dict(rows(render_citations(a, e)))
    # in one pass: a file name that looks like a mark is left alone, unknown marks stay
    assert "explains the flow [one [S2].pdf, pp. 1-2]." in shown[1] and "[b.pdf, p. 3][one [S2].pdf, pp. 1-2]" in shown[1] and "[S9]" in shown[1]
    assert shown[2] == "Nothing is cited [S1, S2] here." and shown[3] == ""


def test_claims(data):
    a, e = data
    c = rows(claims(a).where("query_id = 1"), "claim_id", "claim", "uncited")
    assert ("C1", "However, this model explains the flow .", False) in c and ("C3", "Thus, the last one is not backed by anything .", False) in c
    assert (None, "Cells move along gradients of stiffness in the tissue.", True) in c and (None, "It is short.", False) in c
    prompts = dict(rows(claim_prompts(claims(a), e).where("query_id = 1"), "claim_id", "prompt"))
    assert "SOURCE NOT FOUND" in prompts["C3"] and prompts["C2"].index("[S2]\nsecond") < prompts["C2"].index("[S1]\nfirst")
    assert rows(verification_batches(claims(a)).where("query_id = 1")) == [(1, "C1", 0), (1, "C2", 0), (1, "C3", 1)]


def test_support_prune_renumber(spark, data):
    a, _ = data
    v = spark.createDataFrame([(1, "C1", "SUPPORTED"), (1, "C2", "SUPPORTED"), (1, "C3", "odd"), (1, "C8", "SUPPORTED"), (4, "C1", "SUPPORTED"), (4, "C1", "SUPPORTED")], "query_id int, claim_id string, verdict string")
    got = {r.query_id: r for r in support_check(a, v).collect()}
    assert (got[1].claims, got[1].supported, got[1].unsupported, got[1].uncited, got[1].unknown, got[1].valid) == (3, 2, 1, 1, ["C8"], False)
    assert got[4].valid and not got[2].valid and not got[3].valid
    left = dict(rows(prune(a, v)))
    assert left[1] == "The model explains the flow [S1].\n\nThese results hold for all of the waves [S2][S1]."
    assert left[2] == "" and left[3] == "" and left[4] == "All good [S1]."
    v2 = v.where("claim_id <> 'C1'")
    assert rows(renumbered(claims(a), v2)) == [(1, "C2", "C1")]


def test_finish_and_gate(spark):
    df = spark.createDataFrame([("a [S1", None), ("a [S1]", "stop"), ("a", "length"), (None, None)], "a string, r string")
    assert [r[0] for r in df.select(finished_cleanly(F.col("a"), F.col("r"))).collect()] == [False, True, False, True]
    g = spark.createDataFrame([('{"label": "ANSWERABLE", "reason": "x"}', "stop"), ('{"label": "ANSWERABLE"}', "length"), ("no json", "stop"), ('{"label": "MAYBE"}', "stop"), (None, "stop")], "j string, r string")
    assert [r[0].sufficient for r in g.select(parse_gate(F.col("j"), F.col("r"))).collect()] == [True, False, False, False, False]


def test_outcomes(spark, data):
    a, e = data
    q = spark.createDataFrame([(i, "?") for i in (1, 2, 3, 4, 5)], "query_id int, question string")
    gate = spark.createDataFrame([(1, True), (4, True)], "query_id int, sufficient boolean")
    v = spark.createDataFrame([(4, "C1", "SUPPORTED")], "query_id int, claim_id string, verdict string")
    got = {r.query_id: (r.outcome, r.answer) for r in outcomes(q, e, gate, a.withColumn("done_reason", F.lit("stop")), v).collect()}
    assert got == {1: ("citations invalid", None), 2: ("no evidence", None), 3: ("no evidence", None), 4: ("answered", "All good [c.pdf, p. 1]."), 5: ("no evidence", None)}


def test_repair_feedback(spark, data):
    a, _ = data
    v = spark.createDataFrame([(1, "C1", "SUPPORTED", ""), (1, "C2", "PARTIAL", "half of it"), (4, "C1", "SUPPORTED", None)], "query_id int, claim_id string, verdict string, reason string")
    got = dict(rows(repair_feedback(claims(a), v)))
    assert got == {1: "- NOT CITED: Cells move along gradients of stiffness in the tissue.\n- PARTIAL: These results hold for all of the waves . (half of it)\n- NOT VERIFIED: Thus, the last one is not backed by anything ."}
