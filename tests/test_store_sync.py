import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.plans.manifest import Manifest, differences, ensure_compatible, fingerprint, load_manifest, write_manifest
from vellum.plans.models import HashingEmbedder, InputTooLong, ScriptedChat, embed_column, embed_one, embed_query, generate, pool, split_near_middle, verdict_schema
from vellum.plans.sync import document_state, sync_index, sync_plan
from vellum.sources.library import discover, document_statistics, extract_pages, markdown_export, page_number, parsed_documents, scan_library, write_text
from vellum.sources.store import Store, merged
from vellum.streaming.feed import feed_into, windowed_counts

CHUNK = "chunk_id string, source_path string, source_sha256 string, text string, vector array<float>"


def chunk(i, path, sha="h1", v=(1.0, 0.0)):
    return (i, path, sha, f"text {i}", list(v))


def test_state_and_plan(spark):
    idx = spark.createDataFrame([chunk("1", "/A.pdf"), chunk("2", "/a.pdf", " H1 "), chunk("3", "/b.pdf", "h1"), chunk("4", "/b.pdf", "h2"), chunk("5", None), chunk("6", "/c.pdf", None), chunk("7", "/d.pdf")], CHUNK)
    state = document_state(idx)
    assert rows(state) == [("/a.pdf", ["/A.pdf", "/a.pdf"], ["h1"], 2), ("/b.pdf", ["/b.pdf"], ["h1", "h2"], 2), ("/c.pdf", ["/c.pdf"], [], 1), ("/d.pdf", ["/d.pdf"], ["h1"], 1)]
    lib = spark.createDataFrame([("/A.pdf", "/a.pdf", "H1"), ("/b.pdf", "/b.pdf", "h1"), ("/c.pdf", "/c.pdf", "h1"), ("/new.pdf", "/new.pdf", "h9"), (None, None, "x")], "path string, normalized_path string, sha256 string")
    assert dict(rows(sync_plan(lib, state), "normalized_path", "status")) == {"/a.pdf": "UNCHANGED", "/b.pdf": "CHANGED", "/c.pdf": "CHANGED", "/d.pdf": "DELETED", "/new.pdf": "NEW"}


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        s.open()
    with pytest.raises(ValueError, match="no rows"):
        s.publish(spark.createDataFrame([], CHUNK))
    assert s.publish(spark.createDataFrame([chunk("1", "/a"), chunk("2", "/b")], CHUNK)) == 2
    with pytest.raises(ValueError, match="bad"):
        s.publish(spark.createDataFrame([chunk("9", "/z")], CHUNK), {"bad": F.col("chunk_id") == "9"})
    assert rows(s.open(), "chunk_id") == [("1",), ("2",)]
    s.append(spark.createDataFrame([chunk("3", None)], CHUNK))
    with pytest.raises(ValueError):
        s.append(spark.createDataFrame([], CHUNK))
    s.replace(spark.createDataFrame([chunk("4", "/b"), chunk("1", "/moved")], CHUNK), spark.createDataFrame([("/b",), (None,)], "source_path string"))
    assert rows(s.open(), "chunk_id", "source_path") == sorted([("1", "/moved"), ("3", None), ("4", "/b")], key=repr)
    s.remove(spark.createDataFrame([("/b",)], "source_path string"))
    assert s.compact(1) is None and rows(s.open(), "chunk_id") == [("1",), ("3",)]


def test_sync_twice_is_one(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t")
    s.publish(spark.createDataFrame([chunk("1", "/a", "h1"), chunk("2", "/b", "h1"), chunk("3", "/gone", "h1")], CHUNK))
    lib = spark.createDataFrame([("/a", "/a", "h1"), ("/b", "/b", "h2"), ("/n", "/n", "h3")], "path string, normalized_path string, sha256 string")

    def prepare(files):
        return files.select(F.concat(F.lit("c"), "sha256").alias("chunk_id"), F.col("path").alias("source_path"), F.col("sha256").alias("source_sha256"), F.lit("t").alias("text"), F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>").alias("vector"))

    assert sync_index(s, lib, prepare, dimension=2, dry_run=True).rows is None
    one = sync_index(s, lib, prepare, dimension=2)
    assert (one.new, one.changed, one.unchanged, one.deleted, one.rows) == (1, 1, 1, 1, 4)
    again = sync_index(s, lib, prepare, dimension=2)
    assert (again.new, again.changed, again.unchanged, again.rows) == (0, 0, 3, None)
    assert sync_index(s, lib, prepare, dimension=2, sync_deletions=True).rows == 3
    assert rows(s.open(), "source_path", "source_sha256") == [("/a", "h1"), ("/b", "h2"), ("/n", "h3")]
    more = lib.unionByName(spark.createDataFrame([("/x", "/x", "h4")], lib.schema))
    with pytest.raises(ValueError, match="searchable"):
        sync_index(s, more, lambda f: prepare(f).where("1 = 0"), dimension=2)
    with pytest.raises(ValueError, match="dimension"):
        sync_index(s, more, prepare, dimension=3)


def test_merge_with_clashing_and_empty(spark):
    t = spark.createDataFrame([chunk("1", "/a")], CHUNK)
    none = spark.createDataFrame([], CHUNK)
    scope = spark.createDataFrame([], "source_path string")
    assert rows(merged(t, none, scope), "chunk_id") == [("1",)] and rows(merged(none, t, scope), "chunk_id") == [("1",)]


# A manifest whose fingerprint is known.
SETTINGS = {
    "allow_cross_page_chunks": False, "chunk_max": 700, "chunk_min": 180, "chunk_overlap": 100, "chunk_target": 550, "embedding_model": "nomic-embed-text", "ocr_language": "eng",
    "searchable_chunk_types": ["abstract", "body", "caption", "conclusion", "discussion", "glossary", "introduction", "methods", "results", "sidebar", "supplementary"], "tokenizer_encoding": "cl100k_base", "use_ocr": True,
}


def test_manifest(tmp_path):
    m = Manifest(1, 1, "research_chunks", "research-pdf-parser-v1", "research-chunker-v1", SETTINGS)
    assert fingerprint(m.core()) == "61c475cc14d238745a534930a978be4e1390c4b2f9495045239503ac8ba213ea"
    path = str(tmp_path / "m.json")
    assert load_manifest(path) is None
    with pytest.raises(RuntimeError):
        ensure_compatible(path, m)
    ensure_compatible(path, m, adopt_missing=True, dry_run=True)
    assert load_manifest(path) is None
    ensure_compatible(path, m, adopt_missing=True)
    assert load_manifest(path) == m
    other = Manifest(1, 1, "research_chunks", "research-pdf-parser-v2", "research-chunker-v1", {**SETTINGS, "chunk_max": 800})
    assert set(differences(m, other)) == {"parser_version", "settings.chunk_max"}
    with pytest.raises(RuntimeError, match="chunk_max"):
        ensure_compatible(path, other)
    write_manifest(m, path)
    text = open(path).read()
    for bad in (text.replace("700", "701"), text.replace('"parser_version"', '"x"'), "[]", "{", text.replace('"research_chunks"', "3")):
        open(path, "w").write(bad)
        with pytest.raises(ValueError):
            load_manifest(path)


def test_models(spark):
    model = HashingEmbedder(16, 60)
    long = "Cells move. " * 12
    v = embed_one(model, long, "")
    assert len(v) == 16 and abs(sum(x * x for x in v) - 1) < 1e-5
    with pytest.raises(InputTooLong):
        embed_one(HashingEmbedder(4, 3), "abcdef", "prefix too long: ")
    with pytest.raises(ValueError):
        embed_query(model, "  ")
    with pytest.raises(ValueError):
        pool([[1.0]], [0.0])
    assert split_near_middle("aa bb. Cc dd") == ("aa bb.", "Cc dd") and split_near_middle("abcd") == ("ab", "cd")
    assert split_near_middle("aaaa bbbb\n\ncccc. Dddd") == ("aaaa bbbb", "cccc. Dddd")
    df = spark.createDataFrame([(1, "some text"), (2, None), (3, " "), (4, long), (5, "some text")], "id int, t string")
    got = {r.id: r.v for r in embed_column(df, "t", "v", model, batch=2).collect()}
    assert got[1] == got[5] and got[2] is None and got[3] is None and len(got[4]) == 16
    chat = ScriptedChat([("flow", "It flows [S1].")])
    assert generate(chat, "", "what of flow?") == ("It flows [S1].", "stop")
    with pytest.raises(RuntimeError):
        chat.chat("", "else")
    assert verdict_schema(["C1"])["properties"]["items"]["items"]["properties"]["claim_id"]["enum"] == ["C1"]


def test_library(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "B.PDF").write_bytes(b"one\x0ctwo")
    (tmp_path / "sub" / "a.pdf").write_bytes(b"three")
    (tmp_path / "note.txt").write_bytes(b"no")
    files = discover(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in files.collect()] == ["B.PDF", "a.pdf"]
    for bad, err in ((tmp_path / "none", FileNotFoundError), (tmp_path / "note.txt", NotADirectoryError)):
        with pytest.raises(err):
            discover(spark, str(bad))
    assert {r.sha256 for r in scan_library(spark, str(tmp_path)).collect()} == {hashlib.sha256(x).hexdigest() for x in (b"one\x0ctwo", b"three")}

    def extractor(path, content):
        for i, t in enumerate(content.decode().split("\f"), 1):
            yield {"page_ordinal": i, "text": t, "metadata": {"title": " " if i == 1 else "Title", "page_number": "x" if i == 1 else "7"}, "toc_items": [], "page_boxes": None}

    pages = extract_pages(files, extractor)
    assert rows(pages.select("page_ordinal", "text", page_number(F.col("metadata"), F.col("page_ordinal")).alias("n"))) == [(1, "one", 1), (1, "three", 1), (2, "two", 7)]
    docs = parsed_documents(pages, files)
    assert rows(docs, "filename", "page_count", "title") == [("B.PDF", 2, "Title"), ("a.pdf", 1, None)]
    stats = document_statistics(pages.select(F.col("path").alias("document_id"), "text", F.col("text").alias("raw_text"), "toc_items", "page_boxes", F.array().cast("array<string>").alias("captions")))
    assert rows(stats, "pages", "chars", "captions") == [(1, 5, 0), (2, 6, 0)]
    export = markdown_export(docs.withColumnRenamed("path", "source_path"), pages.join(docs.select("path", "document_id"), "path").select("document_id", F.col("page_ordinal").alias("page_order"), F.col("page_ordinal").alias("page_number"), "text", F.array(F.lit("c")).alias("captions")))
    write_text(export, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out"), wholetext=True).collect()
    assert "Captions:\n- c" in "".join(r.value for r in text)


def test_streaming(spark, tmp_path):
    df = spark.createDataFrame([("/a", "h1", 1), ("/a", "h2", 2), ("/b", "h3", 1)], "path string, sha256 string, at int")
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = feed_into(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda b, n: seen.extend(rows(b)), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(seen) == [("/a", "h2"), ("/b", "h3")]
    e = spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 'x' as k union all select null, 'x'")
    assert [r.n for r in windowed_counts(e, "ts", "k").collect()] == [1]
