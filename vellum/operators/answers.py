"""Citations, claims and outcomes of generated answers, fail closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import CITATION, citation_label, has_incomplete_citation, is_substantive, remove_citations, source_ids, strip

SENTENCE_GAP = r"(?<=[.!?])\s+(?=[*_`\"“‘(\[]*[A-Z0-9])"
# Openings that lean on a sentence before them.
TRANSITIONS = ("Conversely", "Additionally", "Furthermore", "Moreover", "However", "Therefore", "Thus", "Consequently", "In contrast", "By contrast")
# Nouns whose 'This' or 'These' becomes 'The'.
THIS = ("low Reynolds number regime", "high Reynolds number regime", "approximation", "approach", "process", "framework", "theory", "model", "mechanism", "analysis", "result")
THESE = ("analyses", "results", "equations", "parameters", "observations", "deformations")
MAX_CLAIMS = 24


def verify_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """[CIT1, JON4, AGG8] ``query_id, cited, unknown, has_citations, valid`` of each answer.

    ``answers``: ``query_id, answer``; ``evidence``: ``query_id, source_id``, a few rows a query. Valid: something is cited
    and nothing that isn't there. '[S1, S2]' cites nothing. A null answer cites nothing.
    """
    known = evidence.groupBy("query_id").agg(F.collect_set("source_id").alias("known"))
    x = answers.select("query_id", source_ids(F.coalesce("answer", F.lit(""))).alias("cited")).join(known, "query_id", "left")
    x = x.withColumn("unknown", F.array_except("cited", F.coalesce("known", F.array().cast("array<string>"))))
    has = F.size("cited") > 0
    return x.select("query_id", "cited", "unknown", has.alias("has_citations"), (has & (F.size("unknown") == 0)).alias("valid"))


def render_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """[CIT3, JON3] ``query_id, rendered``: source marks replaced by file and pages, in one pass; unknown ones stay.

    ``evidence``: ``query_id, source_id, filename, page_start, page_end``, a few rows a query.
    """
    label = citation_label(F.col("filename"), F.col("page_start"), F.col("page_end"))
    names = evidence.where(label.isNotNull()).groupBy("query_id", "source_id").agg(F.min(label).alias("label")).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("source_id", "label"))).alias("labels"))
    # parts of the answer around marks; marks are set apart by a character that no text has
    parts = F.split(F.regexp_replace(F.coalesce("answer", F.lit("")), CITATION, "\x02\\[S$1\\]\x02"), "\x02")

    def shown(p: Column) -> Column:
        return F.coalesce(F.when(p.rlike(r"^\[S\d+\]$"), F.try_element_at(F.col("labels"), F.regexp_extract(p, CITATION, 0).substr(F.lit(2), F.length(p) - 2))), p)

    return answers.join(names, "query_id", "left").select("query_id", F.array_join(F.transform(parts, shown), "").alias("rendered"))


def answer_segments(answers: DataFrame) -> DataFrame:
    """[GEN13] ``query_id, paragraph, pos, text``: sentences of each answer, by paragraph and line, without bullets."""
    p = answers.select("query_id", F.posexplode(F.split("answer", r"\n\s*\n")).alias("paragraph", "p"))
    lines = F.filter(F.transform(F.split("p", r"[\n\r]+"), strip), lambda x: x != "")
    pieces = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"^\s*[-*•]\s+", ""), SENTENCE_GAP)))
    return p.select("query_id", "paragraph", F.posexplode(F.filter(F.transform(pieces, strip), lambda x: x != "")).alias("pos", "text"))


def claims(answers: DataFrame) -> DataFrame:
    """[GEN14] Segments that say something: ``query_id, paragraph, pos, text, claim, cited, claim_id, uncited``.

    Cited ones are numbered 'C1'… through the answer; ``uncited`` marks those of at least eight words that cite nothing.
    """
    s = answer_segments(answers).withColumns({"claim": remove_citations(F.col("text")), "cited": source_ids(F.col("text"))}).where("claim <> ''")
    has = F.size("cited") > 0
    n = F.sum(has.cast("int")).over(Window.partitionBy("query_id").orderBy("paragraph", "pos"))
    return s.withColumns({"claim_id": F.when(has, F.concat(F.lit("C"), n.cast("string"))), "uncited": ~has & is_substantive(F.col("text"))})


def claim_prompts(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """[CLM2] ``query_id, claim_id, prompt``: each claim with the evidence it cites; what it cites in vain is named so."""
    cited = found.where("claim_id is not null").select("query_id", "claim_id", "claim", F.posexplode("cited").alias("i", "source_id"))
    x = cited.join(evidence.select("query_id", "source_id", F.col("text").alias("source_text")), ["query_id", "source_id"], "left")
    block = F.concat(F.lit("["), "source_id", F.lit("]\n"), F.coalesce("source_text", F.lit("SOURCE NOT FOUND")))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("i", block.alias("b")))), lambda s: s["b"])
    return x.groupBy("query_id", "claim_id", "claim").agg(F.array_join(blocks, "\n\n").alias("b")).select("query_id", "claim_id", F.concat(F.lit("Claim: "), "claim", F.lit("\n\nEvidence:\n"), "b").alias("prompt"))


def verification_batches(found: DataFrame, size: int = 2) -> DataFrame:
    """[CLM3] ``query_id, claim_id, batch``: claims in the order of their numbers, ``size`` to a call."""
    n = F.substring("claim_id", 2, 9).cast("int")
    return found.where("claim_id is not null").select("query_id", "claim_id", F.floor((n - 1) / size).alias("batch"))


def support_check(answers: DataFrame, verdicts: DataFrame, *, max_claims: int = MAX_CLAIMS) -> DataFrame:
    """[CLM3, CLM4, AGG4, JON6] One row a query: counts by verdict, missing and unknown ids, and whether all is supported.

    ``verdicts``: ``query_id, claim_id, verdict``; anything but SUPPORTED and PARTIAL counts as UNSUPPORTED, of
    repeated verdicts the worst holds. Answers without cited claims, with too many, with uncited
    ones of substance, or with ids that are missing or not asked for are invalid.
    """
    c = claims(answers)
    asked = c.groupBy("query_id").agg(F.collect_set("claim_id").alias("expected"), F.count_if("uncited").alias("uncited"))
    rank = F.when(F.col("verdict") == "SUPPORTED", 0).when(F.col("verdict") == "PARTIAL", 1).otherwise(2)
    got = verdicts.where("claim_id is not null").groupBy("query_id", "claim_id").agg(F.max(rank).alias("v")).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("claim_id", "v"))).alias("got"))
    none = F.array().cast("array<string>")
    x = answers.select("query_id").distinct().join(asked, "query_id", "left").join(got, "query_id", "left")
    x = x.withColumns({"expected": F.coalesce("expected", none), "uncited": F.coalesce("uncited", F.lit(0)), "returned": F.coalesce(F.map_keys("got"), none)})
    x = x.withColumns({"missing": F.array_sort(F.array_except("expected", "returned")), "unknown": F.array_sort(F.array_except("returned", "expected"))})
    x = x.withColumn("v", F.filter(F.transform("expected", lambda i: F.try_element_at(F.col("got"), i)), lambda v: v.isNotNull()))

    def count(k: int) -> Column:
        return F.size(F.filter("v", lambda v: v == k))

    n = F.size("expected")
    valid = (n > 0) & (n <= max_claims) & (F.size("missing") == 0) & (F.size("unknown") == 0) & (F.col("uncited") == 0) & (count(0) == n)
    return x.select("query_id", n.alias("claims"), count(0).alias("supported"), count(1).alias("partial"), count(2).alias("unsupported"), "uncited", "missing", "unknown", valid.alias("valid"))


def clean_opening(text: Column) -> Column:
    """[CLM5] A sentence whose predecessor went: no transition in front, 'The' for 'This' and 'These', a capital."""
    x = strip(text)
    for t in TRANSITIONS:
        x = F.regexp_replace(x, rf"(?i)^{t},\s+", "")
    for word, nouns in (("This", THIS), ("These", THESE)):
        for noun in nouns:
            x = F.regexp_replace(x, rf"(?i)^{word} {noun}\b", f"The {noun}")
    return F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.length(x)))


def prune(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """[CLM5, CLM6] ``query_id, answer``: what is left of each answer when only supported, cited sentences stay.

    The first sentence kept of a paragraph is cleaned if another stood before it. Nothing kept gives ''.
    """
    worst = verdicts.groupBy("query_id", "claim_id").agg(F.min((F.col("verdict") == "SUPPORTED").cast("int")).alias("ok"))
    x = claims(answers).join(worst, ["query_id", "claim_id"], "left").withColumn("keep", F.coalesce(F.col("ok") == 1, F.lit(False)))
    w = Window.partitionBy("query_id", "paragraph").orderBy("pos")
    x = x.withColumns({"nth": F.row_number().over(w), "kept": F.sum(F.col("keep").cast("int")).over(w)}).where("keep")
    text = F.when((F.col("kept") == 1) & (F.col("nth") > 1), clean_opening(F.col("text"))).otherwise(F.col("text"))
    ps = x.withColumn("t", text).groupBy("query_id", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]), " ").alias("p"))
    whole = ps.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "p"))), lambda s: s["p"]), "\n\n").alias("pruned"))
    return answers.select("query_id").distinct().join(whole, "query_id", "left").select("query_id", F.coalesce("pruned", F.lit("")).alias("answer"))


def repair_feedback(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """[AGG10] ``query_id, feedback``: what of an answer has to be repaired, in its order; answers without fault don't come out.

    ``verdicts``: ``query_id, claim_id, verdict, reason``. Claims without verdict count as not verified.
    """
    v = verdicts.groupBy("query_id", "claim_id").agg(F.max_by(F.struct("verdict", "reason"), F.when(F.col("verdict") == "SUPPORTED", 0).when(F.col("verdict") == "PARTIAL", 1).otherwise(2)).alias("v"))
    x = found.where("claim_id is not null or uncited").join(v, ["query_id", "claim_id"], "left").where("claim_id is null or v is null or v.verdict is null or v.verdict <> 'SUPPORTED'")
    judged = F.concat(F.lit("- "), F.coalesce("v.verdict", F.lit("NOT VERIFIED")), F.lit(": "), "claim", F.when(F.col("v.reason") != "", F.concat(F.lit(" ("), "v.reason", F.lit(")"))).otherwise(""))
    line = F.when(F.col("claim_id").isNull(), F.concat(F.lit("- NOT CITED: "), "claim")).otherwise(judged)
    ordered = F.array_sort(F.collect_list(F.struct("paragraph", "pos", line.alias("line"))))
    return x.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("feedback"))


def renumbered(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """[CLM6] ``query_id, old_id, claim_id``: the supported claims, numbered anew."""
    n = F.substring("claim_id", 2, 9).cast("int")
    ok = verdicts.groupBy("query_id", "claim_id").agg(F.min((F.col("verdict") == "SUPPORTED").cast("int")).alias("ok")).where("ok = 1")
    x = found.where("claim_id is not null").join(ok, ["query_id", "claim_id"], "left_semi")
    return x.select("query_id", F.col("claim_id").alias("old_id"), F.concat(F.lit("C"), F.row_number().over(Window.partitionBy("query_id").orderBy(n)).cast("string")).alias("claim_id"))


def finished_cleanly(answer: Column, done_reason: Column) -> Column:
    """[GEN21] Complete: not within a source mark, and stopped by itself where a reason is known."""
    return F.coalesce(done_reason == "stop", F.lit(True)) & ~has_incomplete_citation(F.coalesce(answer, F.lit("")))


def parse_gate(response: Column, done_reason: Column) -> Column:
    """[GAT2] ``struct(sufficient, reason)`` of a model's JSON; anything but a finished, well-formed ANSWERABLE is insufficient."""
    j = F.from_json(response, "label string, reason string")
    ok = (done_reason == "stop") & (j["label"] == "ANSWERABLE")
    bad = F.when(done_reason != "stop", "not finished").when(j["label"].isNull(), "not readable").when(~j["label"].isin("ANSWERABLE", "INSUFFICIENT"), "no such label")
    return F.struct(F.coalesce(ok, F.lit(False)).alias("sufficient"), F.coalesce(bad, j["reason"], F.lit("")).alias("reason"))


def outcomes(queries: DataFrame, evidence: DataFrame, gate: DataFrame, answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """[QA1, QA2] ``query_id, outcome, answer``: where each question's way ends, and its rendered answer.

    ``queries``: ``query_id, question``; ``gate``: ``query_id, sufficient``; ``answers``: ``query_id, answer, done_reason``. An answer that
    isn't supported throughout is pruned; it counts if what is left still cites something valid.
    """
    has = evidence.groupBy("query_id").agg(F.count("*").alias("n"))
    checked = verify_citations(answers, evidence).select("query_id", F.col("valid").alias("cited"))
    supported = support_check(answers, verdicts).select("query_id", F.col("valid").alias("supported"))
    left = prune(answers, verdicts)
    left_ok = verify_citations(left, evidence).select("query_id", F.col("valid").alias("pruned_ok"))
    x = queries.select("query_id").join(has, "query_id", "left").join(gate.select("query_id", "sufficient"), "query_id", "left").join(answers.select("query_id", "answer", "done_reason"), "query_id", "left")
    x = x.join(checked, "query_id", "left").join(supported, "query_id", "left").join(left.withColumnRenamed("answer", "pruned"), "query_id", "left").join(left_ok, "query_id", "left")
    outcome = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "no evidence")
        .when(~F.coalesce("sufficient", F.lit(False)), "insufficient evidence")
        .when(F.col("answer").isNull() | ~finished_cleanly(F.col("answer"), F.col("done_reason")), "not generated")
        .when(~F.coalesce("cited", F.lit(False)), "citations invalid")
        .when(F.coalesce("supported", F.lit(False)), "answered")
        .when(F.coalesce("pruned_ok", F.lit(False)), "answered in part")
        .otherwise("claims not supported")
    )
    final = x.select("query_id", outcome.alias("outcome"), F.when(outcome == "answered", F.col("answer")).when(outcome == "answered in part", F.col("pruned")).alias("answer"))
    shown = render_citations(final.where("answer is not null").select("query_id", "answer"), evidence)
    return final.select("query_id", "outcome").join(shown.withColumnRenamed("rendered", "answer"), "query_id", "left")
