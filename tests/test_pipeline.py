"""Pages to index to answers, with stand-ins for the models."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.__main__ import main
from vellum.plans.indexing import answer_questions, build_semantic_index
from vellum.plans.manifest import Manifest, load_manifest
from vellum.plans.models import HashingEmbedder
from vellum.plans.queries import SEARCHABLE
from vellum.sources.store import Store

TEXT = {
    "a": "# Results\n\nTopological defects steer the shape of growing tissue sheets. Cells around a defect turn and extrude, which bends the sheet over many hours of growth.\n\n# References\n\nSomeone, somewhere, some year.",
    "b": "# Methods\n\nWe embedded cells in a soft gel and measured the pressure of the medium with a small sensor. The gel was cast between two plates of glass and kept warm for days.",
    "c": "# References\n\nOnly a list of works that nobody searches.",
}


class Chat:
    def chat(self, system, user, schema=None):
        if "JSON" in system:
            return json.dumps({"label": "INSUFFICIENT" if "pressure" in user.split("Evidence")[0] else "ANSWERABLE", "reason": "r"}), "stop"
        if "Answer" in system:
            if "extrude" in user.split("Evidence")[0]:
                raise RuntimeError("down")
            return "Defects steer the shape of tissue [S1]. However, this model shows that moons are made of cheese [S1].", "stop"
        return ("UNSUPPORTED" if "cheese" in user else "SUPPORTED"), "stop"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("index")
    pages = spark.createDataFrame([(d, 1, 1, t, ["Figure 1. A sheet of tissue with one defect in it."] if d == "a" else None) for d, t in TEXT.items()], "document_id string, page_order long, page_number int, text string, captions array<string>")
    docs = spark.createDataFrame([(d, f"{d}.pdf", f"/lib/{d}.pdf", f"sha{d}", "T" if d == "a" else None, None) for d in TEXT], "document_id string, filename string, source_path string, sha256 string, title string, author string")
    m = Manifest(1, 1, "chunks", "p", "c", {"embedding_model": "hash"})
    s = Store(spark, f"file://{root}/t")
    n = build_semantic_index(s, pages, docs, HashingEmbedder(32), m, str(root / "m.json"), dimension=32)
    assert n == 3 and load_manifest(str(root / "m.json")) == m
    with pytest.raises(ValueError):
        build_semantic_index(s, pages, docs, HashingEmbedder(16), m, str(root / "x.json"), dimension=32)
    assert not (root / "x.json").exists()
    return s


def test_index(store):
    t = store.open()
    assert rows(t, "document_id", "chunk_type", "title") == [("a", "caption", "T"), ("a", "results", "T"), ("b", "methods", "")]
    assert set(r.chunk_type for r in t.collect()) <= set(SEARCHABLE) and {len(r.vector) for r in t.collect()} == {32}


def test_answers(spark, store):
    q = spark.createDataFrame([(1, "How do topological defects control tissue shape?"), (2, "What dosing of pembrolizumab-12 is given?"), (3, "What pressure had the medium?"), (4, "Why do cells extrude?")], "query_id int, question string")
    got = {r.query_id: (r.outcome, r.answer) for r in answer_questions(q, store.open(), HashingEmbedder(32), Chat(), dimension=32).collect()}
    assert got[1][0] == "answered in part" and got[1][1].startswith("Defects steer the shape of tissue [a.pdf, p. 1]") and "cheese" not in got[1][1]
    assert got[2] == ("insufficient evidence", None) and got[3] == ("insufficient evidence", None) and got[4] == ("not generated", None)
    with pytest.raises(ValueError):
        answer_questions(q.withColumn("question", F.lit(" ")), store.open(), HashingEmbedder(32), Chat(), dimension=32)


def test_console(store, capsys):
    main(["search", store.root, "defects of tissue", "--top-k", "1"])
    main(["chunks", f"{store.root}/{store.current()}"])
    main(["compact", store.root])
    out = capsys.readouterr().out
    assert "a.pdf" in out and "chunks" in out and "done" in out
    with pytest.raises(SystemExit):
        main(["search", store.root, " "])


def test_console_prints_all_rows(spark, tmp_path, capsys):
    """More than 1,000 documents come out whole and in order."""
    schema = "document_id string, text string, raw_text string, toc_items array<string>, page_boxes array<string>, captions array<string>"
    n = 1005
    spark.createDataFrame([(f"d{i:04d}", "x", "xy", None, None, None) for i in range(n)], schema).write.parquet(str(tmp_path / "pages"))
    main(["pages", str(tmp_path / "pages")])
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].split("\t")[:2] == ["document_id", "pages"] and [x.split("\t")[0] for x in lines[1:]] == [f"d{i:04d}" for i in range(n)]
