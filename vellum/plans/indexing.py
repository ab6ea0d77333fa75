"""From pages to a published index, and from questions to answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.headings import is_searchable
from vellum.functions.text import strip
from vellum.operators.answers import claim_prompts, claims, outcomes, parse_gate
from vellum.operators.chunking import ChunkSizes, assemble_chunks, segments
from vellum.operators.evidence import evidence_context, lexical_gate, select_evidence
from vellum.operators.layout import document_blocks, repair_interrupted
from vellum.operators.retrieval import build_index, retrieve
from vellum.operators.vectors import nearest_neighbours
from vellum.plans.manifest import Manifest, write_manifest
from vellum.plans.models import QUERY_PREFIX, ChatModel, Embedder, embed_column, generate
from vellum.plans.shared import written
from vellum.plans.sync import records, vector_checks
from vellum.sources.store import Store

# Own wording; a model may be given another.
GATE = "Say whether the evidence can answer the question, as JSON with label ANSWERABLE or INSUFFICIENT and a reason."
ANSWER = "Answer from the evidence alone. Put its mark, such as [S1], before the full stop of each sentence."
VERIFY = "Say whether the evidence supports the claim: SUPPORTED, PARTIAL or UNSUPPORTED."


def chunks_of(pages: DataFrame, documents: DataFrame, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """[GEN12] Chunks of documents: blocks, repair, segments, assembly.

    ``pages``: ``document_id, page_order, page_number, text, captions``, each page once; ``documents``: ``document_id, sha256, title``.
    """
    titled = pages.join(documents.select("document_id", "title"), "document_id")
    blocks = repair_interrupted(document_blocks(titled.select("document_id", "title", "page_order", "page_number", "text", "captions")))
    return assemble_chunks(segments(blocks, sizes), documents, sizes)


def prepare_records(pages: DataFrame, documents: DataFrame, model: Embedder, model_name: str, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """[IDX1, IDX4, JON2] Index rows of documents: unsearched types are dropped before anything is embedded; vectors come as a column, not by position."""
    chunks = chunks_of(pages, documents, sizes).where(is_searchable(F.col("chunk_type")))
    # written, so that no later step calls the model again
    embedded = written(embed_column(chunks, "text", "vector", model), "embedded")
    return records(documents, embedded, model_name)


def build_semantic_index(store: Store, pages: DataFrame, documents: DataFrame, model: Embedder, manifest: Manifest, manifest_path: str, *, dimension: int, sizes: ChunkSizes = ChunkSizes()) -> int:
    """[IDX2] Build and publish the whole index, then its manifest; gives the number of rows. Documents without searched chunks are left out; nothing is published if any row fails the checks."""
    n = store.publish(prepare_records(pages, documents, model, manifest.settings.get("embedding_model", ""), sizes), vector_checks(dimension))
    write_manifest(manifest, manifest_path)
    return n


def _asked(df: DataFrame, out: str, call) -> DataFrame:
    """Rows with what a model says to them: ``out`` and ``done_reason``; an error becomes the reason, so that the question fails closed."""
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said, why = [], []
            for row in f.to_dict("records"):
                try:
                    a, r = call(row)
                except Exception as e:  # the model's failure is the question's, not the job's
                    a, r = None, f"error: {e}"
                said.append(a)
                why.append(r)
            yield f.assign(**{out: pd.Series(said, dtype=object), "done_reason": pd.Series(why, dtype=object)})

    fields = ", ".join(f"`{n}` {t}" for n, t in df.select(names).dtypes)
    return df.mapInPandas(run, f"{fields}, {out} string, done_reason string")


def answer_questions(questions: DataFrame, index: DataFrame, embedder: Embedder, chat: ChatModel, *, dimension: int, retrieval_k: int = 12, final_k: int = 8, budget: int = 9000, model_gate: bool = True) -> DataFrame:
    """[QA1, GEN20, GAT2, CLM3] ``query_id, outcome, answer`` of a whole set of questions.

    ``questions``: ``query_id, question``, blank ones are refused; ``index``: rows of the chunk table. Search, evidence and lexical gate are plans;
    the model is asked only for what passed them. Its answers are written before they are checked, so each is made once.
    """
    blank = questions.where(F.coalesce(strip(F.col("question")), F.lit("")) == "")
    if not blank.isEmpty():
        raise ValueError("an empty question")
    q = written(embed_column(questions.select("query_id", "question"), "question", "vector", embedder, prefix=QUERY_PREFIX), "questions")
    postings, stats = build_index(index, "chunk_id", F.col("text"))
    near = nearest_neighbours(index, q, "chunk_id", "query_id", "vector", retrieval_k * 3, dim=dimension).select("query_id", F.col("row_id").alias("id"), "rank")
    types = index.select(F.col("chunk_id").alias("id"), "chunk_type", "section").dropDuplicates(["id"])
    found = retrieve(postings, stats, q, types, near, retrieval_k).select("query_id", F.col("id").alias("chunk_id"), F.col("final_rank").alias("rank"))
    held = index.select("chunk_id", "text", "filename", "title", "author", "page_start", "page_end", "section", "chunk_type").dropDuplicates(["chunk_id"])
    evidence = written(select_evidence(found.join(held, "chunk_id"), final_k, budget), "evidence")
    gate = lexical_gate(q, evidence).select("query_id", "sufficient").join(evidence.select("query_id").distinct(), "query_id", "left_semi")
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\n\nEvidence:\n"), "context")
    open_ = evidence_context(evidence).join(gate.where("sufficient"), "query_id", "left_semi").join(q.select("query_id", "question"), "query_id").select("query_id", prompt.alias("prompt"))
    if model_gate:
        said = written(_asked(open_, "reply", lambda r: chat.chat(GATE, r["prompt"], {"enum": ["ANSWERABLE", "INSUFFICIENT"]})), "gate")
        judged = said.select("query_id", parse_gate(F.col("reply"), F.col("done_reason"))["sufficient"].alias("sufficient"))
        gate = gate.where("not sufficient").unionByName(judged)
        open_ = open_.join(judged.where("sufficient"), "query_id", "left_semi")
    answers = written(_asked(open_, "answer", lambda r: generate(chat, ANSWER, r["prompt"])).select("query_id", "answer", "done_reason"), "answers")
    asked = claim_prompts(claims(answers), evidence)
    verdicts = written(_asked(asked, "verdict", lambda r: chat.chat(VERIFY, r["prompt"])).select("query_id", "claim_id", F.trim("verdict").alias("verdict")), "verdicts")
    return outcomes(q, evidence, gate, answers, verdicts)
