import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscan.operators import answer, store
from folioscan.options import Options
from folioscan.plans.engine import Engine
from folioscan.sources import files
from folioscan.streaming import ingest


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "documents"
    d.mkdir()
    (d / "leave.txt").write_bytes("Annual leave is fifteen days.\r\nCarry over five days.".encode())
    (d / "NOTES.TXT").write_text("Travel is reimbursed within thirty days.")
    (d / "empty.txt").write_text("")
    (d / "broken.txt").write_bytes(b"\xff\xfe bad")
    (d / "old.doc").write_bytes(b"not a zip file")
    (d / "manual.docx").write_bytes(docx("Product manual", "Press the green button."))
    (d / "picture.png").write_bytes(b"png")
    return str(d)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Options(warehouse=str(tmp_path / "warehouse"), embedding_dim=256))


def questions(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, question string, top_k int, with_sources boolean")


def test_options_from_environment():
    o = Options.from_environment({"CHUNK_SIZE": "64", "AUTO_INGEST": "Yes", "SIMILARITY_THRESHOLD": "0.2", "SUPPORTED_EXTS": ".TXT, .md"})
    assert (o.chunk_size, o.auto_ingest, o.score_threshold, o.supported_exts) == (64, True, 0.2, (".txt", ".md"))
    assert Options.from_environment({"AUTO_INGEST": "no"}).auto_ingest is False


def test_scan_filters_by_suffix(spark, folder):
    names = [r["name"] for r in files.listing(files.scan(spark, folder, (".txt",))).collect()]
    assert names == ["NOTES.TXT", "broken.txt", "empty.txt", "leave.txt"]
    assert files.scan(spark, folder).count() == 7
    assert files.scan(spark, folder + "-none", (".txt",)).count() == 0


def test_parse_isolates_errors(spark, folder):
    rows = {r["source"]: r for r in files.parse(files.scan(spark, folder)).collect()}
    assert rows["leave.txt"]["text"] == "Annual leave is fifteen days.\nCarry over five days."
    assert rows["manual.docx"]["text"] == "Product manual\nPress the green button."
    assert {n for n, r in rows.items() if r["error"]} == {"broken.txt", "old.doc", "picture.png"}


def test_missing_files_are_error_rows(spark, folder):
    found, gone = files.scan_paths(spark, [f"{folder}/leave.txt", "/none/x.txt", f"{folder}/empty.txt", folder])
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["empty.txt", "leave.txt"]
    assert [(r["source"], r["error"]) for r in files.missing(spark, gone[:1]).collect()] == [("x.txt", "file not found")] and gone[1:] == [folder]
    assert files.scan_paths(spark, ["/none/x.txt"])[0].count() == 0


def test_ingest_counts_and_answers(spark, engine, folder):
    assert engine.ingest_directory(folder).first().asDict() == {"success": 4, "failed": 2, "total_chunks": 3, "vector_count": 3}
    rows = questions(spark, (1, "annual leave is fifteen days carry over five days", None, True), (2, "zzz reimbursed qqq", 1, True), (3, "green button", 0, False), (4, "  ", None, True))
    hits = engine.hits(rows)
    first = hits.filter("query_id = 1").first()
    assert first["chunk_id"] == "leave.txt_0" and first["path"] == "primary" and first["score"] > 0.7
    assert [r["chunk_id"] for r in hits.filter("query_id = 2").collect()] == ["NOTES.TXT_0"]
    got = {r["query_id"]: r for r in engine.answer(rows).collect()}
    assert got[1]["answer"].startswith("[相似度：") and got[1]["sources"][0]["file"] == "leave.txt"
    assert got[3]["sources"] is None and got[3]["context_used"] == 3
    assert got[4]["answer"] == answer.NOT_FOUND and got[4]["hallucination_risk"] is None


def test_generator_errors_become_rows(spark, engine, folder):
    engine.ingest_directory(folder)
    engine.generator = lambda prompt: F.struct(F.lit(None).cast("string").alias("answer"), F.lit("down").alias("error"))
    row = engine.answer(questions(spark, (1, "leave", None, True))).first()
    assert row["error"] == "down" and row["answer"].endswith("down") and row["hallucination_risk"] is None


def test_append_leaves_existing_ids_and_upsert_replaces(spark, engine, folder):
    engine.ingest_directory(folder)
    with open(f"{folder}/leave.txt", "w") as f:
        f.write("Leave rules have changed.")
    assert engine.ingest_directory(folder).first()["vector_count"] == 3
    content = lambda: engine.collection.read().filter("chunk_id = 'leave.txt_0'").first()["content"]
    assert content().startswith("Annual")
    engine.ingest_directory(folder, "upsert")
    assert content().startswith("Leave rules")


def test_one_id_given_twice_is_an_error(spark, engine):
    row = ("a_0", "a", "/a", 0, "x", None, [1], [1.0])
    rows = spark.createDataFrame([row, row], engine.collection.read().schema)
    for write in (engine.collection.append, engine.collection.upsert, engine.collection.rebuild):
        with pytest.raises(ValueError, match="a_0"):
            write(rows)


def test_change_detection(spark, engine, folder, tmp_path):
    assert engine.ingest_if_changed(str(tmp_path / "none")) == "empty"
    assert engine.ingest_if_changed(folder) == "reindexed"
    assert engine.ingest_if_changed(folder) == "cached"
    time.sleep(1.1)
    with open(f"{folder}/leave.txt", "a") as f:
        f.write(" More.")
    assert engine.ingest_if_changed(folder) == "reindexed"
    assert Engine(spark, Options(warehouse=engine.options.warehouse, embedding_dim=256, chunk_size=100)).ingest_if_changed(folder) == "reindexed"
    engine.clear()
    assert engine.collection.is_empty() and engine.ingest_if_changed(folder) == "reindexed"


def test_start_ingests_an_empty_index_only(engine, folder):
    assert engine.ingest_on_start(folder) is True
    assert engine.ingest_on_start(folder) is False
    assert engine.stats().first()["vector_store"]["document_count"] == 3


def test_upload_stream_appends(engine, folder, tmp_path):
    ingest.start(engine, folder, str(tmp_path / "checkpoint")).awaitTermination()
    assert engine.collection.read().count() == 3
    with open(f"{folder}/more.txt", "w") as f:
        f.write("Another file.")
    ingest.start(engine, folder, str(tmp_path / "checkpoint")).awaitTermination()
    assert engine.collection.read().count() == 4


def test_collection_names(spark):
    name = lambda m, p=False: spark.range(1).select(store.collection_name(F.lit(m), F.lit(p))).first()[0]
    assert name("text-embedding-v3") == "kb_text_embedding_v3"
    assert name("/models/bge-m3", True) == "kb_bge_m3"
    assert name("m3") == "kb_default_model"
    assert len(name("x" * 90)) == 43


def test_prompt_keeps_braces(spark):
    row = spark.range(1).select(answer.prompt(F.lit("{question}"), F.lit("{x}"), "C {context} Q {question}").alias("p")).first()
    assert row["p"] == "C {question} Q {x}"


def test_custom_embedder_gets_small_batches_in_order(spark):
    from folioscan.functions.embedders import Custom, Precomputed

    def encode(texts):
        assert len(texts) <= 10
        return [[len(t), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, "x" * i) for i in range(25)], "k long, t string").coalesce(1)
    got = {r["k"]: r["weights"] for r in Custom(encode, 2).vectors(rows, "k", "t").collect()}
    assert all(abs(got[i][0] - i / (i * i + 1) ** 0.5) < 1e-12 for i in range(25))
    table = spark.createDataFrame([(3, [3.0, 4.0])], "key long, vector array<double>")
    assert [r["weights"] for r in Precomputed(table, 2).vectors(rows, "k", "t").collect()] == [[0.6, 0.8]]


def test_engine_with_a_custom_embedder(spark, folder, tmp_path):
    from folioscan.functions.embedders import Custom

    engine = Engine(spark, Options(warehouse=str(tmp_path / "warehouse")), embedder=Custom(lambda texts: [[t.count("leave") + 1e-3, t.count("button")] for t in texts], 2))
    engine.ingest_directory(folder)
    hits = engine.hits(questions(spark, (1, "button", 1, True))).collect()
    assert [r["chunk_id"] for r in hits] == ["manual.docx_0"]
    assert engine.health().first()["status"] == "healthy"


def test_ingest_by_path_counts_missing_files(engine, folder):
    got = engine.ingest_paths([f"{folder}/leave.txt", f"{folder}/none.txt", f"{folder}/picture.png", f"{folder}/empty.txt"]).first().asDict()
    assert got == {"success": 2, "failed": 2, "total_chunks": 1, "vector_count": 1}


def test_blank_questions_of_any_spaces(spark, engine, folder):
    engine.ingest_directory(folder)
    rows = questions(spark, *((i, q, None, True) for i, q in enumerate(["\t\n", "\u3000\u00a0 ", "", None, "\x1f\x85", " leave\t"])))
    assert {r["query_id"] for r in engine.hits(rows).collect()} == {5}


def test_only_new_chunks_are_embedded(spark, folder, tmp_path):
    from folioscan.functions.embedders import Custom

    log = tmp_path / "log"
    log.mkdir()

    def encode(texts):
        with open(log / f"{time.time_ns()}-{id(texts)}", "w") as f:
            f.write(str(len(texts)))
        return [[float(len(t)), 1.0] for t in texts]

    engine = Engine(spark, Options(warehouse=str(tmp_path / "warehouse")), embedder=Custom(encode, 2))
    embedded = lambda: sum(int(p.read_text()) for p in log.iterdir())
    engine.ingest_directory(folder)
    assert embedded() == 3
    with open(f"{folder}/more.txt", "w") as f:
        f.write("One more file.")
    assert engine.ingest_directory(folder).first()["vector_count"] == 4
    assert embedded() == 4


def test_metadata_and_default_ids(spark, engine):
    assert engine.add_documents(["first", "second"], [{"chunk_id": "own", "source": "s", "lang": "en"}, {}]) == 2
    rows = {r["chunk_id"]: r for r in engine.collection.read().collect()}
    assert rows["own"]["extra"] == {"lang": "en"} and rows["own"]["source"] == "s" and rows["doc_1"]["content"] == "second" and rows["doc_1"]["extra"] is None
    parsed = spark.createDataFrame([("t", "/t", "a text with metadata", {"team": "x"})], "source string, file_path string, text string, extra map<string,string>")
    assert engine.ingest_texts(parsed).first()["vector_count"] == 3
    assert engine.collection.read().filter("source = 't'").first()["extra"] == {"team": "x"}


def test_uploads_and_messages(engine, folder, tmp_path):
    row = engine.upload({"up.txt": b"An uploaded file.", "bad.bin": b"x"}, str(tmp_path / "documents")).first()
    assert row["message"] == "2 files uploaded" and (row["stats"]["success"], row["stats"]["failed"]) == (1, 1)
    assert (tmp_path / "documents" / "up.txt").read_bytes() == b"An uploaded file."
    assert engine.rebuilt(str(tmp_path / "none")).first()["message"].startswith("index cleared")
    assert engine.rebuilt(folder).first()["stats"]["success"] == 5
    assert engine.clear().first()["message"] == "index cleared" and engine.about().first()["version"]


def test_settings_file(tmp_path):
    path = tmp_path / "settings"
    path.write_text("# comment\nexport TOP_K=9\nLLM_MODEL='m 1'\nLLM_API_KEY=\"k\"\nCHUNK_SIZE=1\n\nnonsense\n")
    o = Options.from_environment({"CHUNK_SIZE": "77"}, str(path))
    assert (o.top_k, o.llm_model, o.llm_api_key, o.embedding_api_key, o.chunk_size) == (9, "m 1", "k", "k", 77)
    assert Options.from_environment({}, str(tmp_path / "none")).top_k == 5


def test_pdf_pages(monkeypatch):
    import sys
    import types

    class Page:
        def __init__(self, text):
            self.extract_text = lambda: text

    class Reader:
        def __init__(self, stream):
            self.pages = [Page(t) for t in stream.read().decode().split("|")] + [Page(None)]

    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    assert files.read_pdf(b"one|two") == "one\ntwo\n\n"
    monkeypatch.setitem(sys.modules, "pypdf", None)
    with pytest.raises(RuntimeError, match="pypdf"):
        files.read_pdf(b"x")


def test_a_pdf_without_its_parser_is_an_error_row(spark, folder):
    with open(f"{folder}/paper.pdf", "wb") as f:
        f.write(b"%PDF-1.4 broken")
    rows = {r["source"]: r for r in files.parse(files.scan(spark, folder)).collect()}
    assert rows["paper.pdf"]["text"] is None and rows["paper.pdf"]["error"]
    texts = {".pdf": lambda content: content.decode()[:4]}
    assert {r["source"]: r["text"] for r in files.parse(files.scan(spark, folder), texts).collect()}["paper.pdf"] == "%PDF"


def test_dataset_index_is_written(spark, tmp_path):
    import json

    docs = spark.createDataFrame([("b",), ("a",)], "source string")
    store.write_dataset_index(store.dataset_index(docs, docs), str(tmp_path / "index.json"))
    assert json.loads((tmp_path / "index.json").read_text()) == {"total_documents": 2, "document_list": ["a", "b"], "total_chunks": 2}


@pytest.fixture
def model_server():
    import json
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path.endswith("/embeddings"):
                assert len(body["input"]) <= 10
                reply = {"data": [{"index": i, "embedding": [float("leave" in t), float("button" in t), 0.1]} for i, t in reversed(list(enumerate(body["input"])))]}
            else:
                text = body["messages"][-1]["content"]
                assert body["max_tokens"] == 1024 and self.headers["Authorization"] == "Bearer secret"
                reply = {"choices": [{"message": {"content": "fifteen [来源：leave.txt]"}}]} if "leave" in text else {}
            data = json.dumps(reply).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/v1"
    server.shutdown()


def test_remote_models(spark, folder, tmp_path, model_server):
    options = Options(warehouse=str(tmp_path / "warehouse"), embedding_dim=3, embedding_api_base=model_server, llm_api_base=model_server, llm_api_key="secret", llm_model="m")
    engine = Engine(spark, options)
    engine.ingest_directory(folder)
    got = {r["query_id"]: r for r in engine.answer(questions(spark, (1, "annual leave?", 1, True), (2, "green button?", 1, True))).collect()}
    assert got[1]["answer"].startswith("fifteen") and got[1]["hallucination_risk"]["risk_level"] == "low" and got[1]["sources"][0]["file"] == "leave.txt"
    assert got[2]["error"] and got[2]["hallucination_risk"] is None
