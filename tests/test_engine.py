from __future__ import annotations

import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from skein import cli, errors
from skein.engine import Engine
from skein.operators import bm25
from skein.plans import answering, evaluation
from skein.plans.ingestion import IngestConfig
from skein.sources import files
from skein.streaming.ingest import watch

REPORT = "Quarterly report. Total revenue was $5.3 million in Q3 2023, a growth of 12%. Net profit reached $670 thousand on Mar 5, 2024. The board met twice and approved the plan for the coming year without further changes."


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("First " + "paragraph of the memo about expenses. " * 6) + p(" ") + f"<w:tbl><w:tr>{cell('a')}{cell(' b ')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("docProps/core.xml", '<c xmlns:dc="x"><dc:title>Memo</dc:title><dc:creator>Me</dc:creator></c>')
    return out.getvalue()


def xlsx() -> bytes:
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>Item </t></si><si><r><t>Val</t></r><r><t>ue</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2"><v>5</v></c></row><row><c r="A3" t="inlineStr"><is><t>x</t></is></c><c r="B3"><v>7.5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    (d / "sub").mkdir()
    (d / "report.txt").write_text(REPORT)
    (d / "company.csv").write_text("Company;Revenue;Profit\nA;1000000;100000\nB;2500000;350000\nC;1800000;220000\n")
    (d / "sub/memo.docx").write_bytes(docx())
    (d / "sub/book.xlsx").write_bytes(xlsx())
    (d / "sub/bad.xlsx").write_bytes(b"no zip at all")
    (d / "odd.bin").write_bytes(b"?")
    return d


@pytest.fixture(scope="module")
def engine(spark, folder, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('catalog')}")
    log = {r.path.rpartition("/")[2]: r for r in e.ingest(f"file://{folder}").collect()}
    assert {n: r.success for n, r in log.items()} == {"report.txt": True, "company.csv": True, "memo.docx": True, "book.xlsx": True, "bad.xlsx": False, "odd.bin": False}
    assert "Unsupported" in log["odd.bin"].error and "Content is not" in log["bad.xlsx"].error
    return e


def test_parsers():
    pages, tables, meta = files.parse_docx(docx())
    assert pages[0][1].startswith("First paragraph") and tables == [(["a", "b"], [["1", "2"]], None, None)] and meta["author"] == "Me"
    _, tables, meta = files.parse_xlsx(xlsx())
    assert tables == [(["Item", "Value"], [[None, "5"], ["x", "7.5"]], "Data", None)] and meta["sheet_names"] == "Data"
    assert files.parse_csv(b"a;b\n1;\n2;3\n")[1] == [(["a", "b"], [["1", None], ["2", "3"]], None, None)]
    assert files.parse_csv(b"") == ([], [], {}) and files.parse_txt("é x\ny".encode())[2] == {"line_count": "2", "char_count": "5", "word_count": "3"}
    assert files.get_parser(".XLS") is files.parse_xlsx
    with pytest.raises(errors.UnsupportedFileTypeError, match="Unsupported"):
        files.get_parser("zip")


def test_csv_source(spark, folder):
    df = files.read_csv(spark, f"file://{folder}/company.csv")
    assert df.columns == ["Company", "Revenue", "Profit"] and df.agg(F.sum("Revenue")).first()[0] == 5300000


def test_catalog_holds_what_was_ingested(spark, engine):
    docs = {r.filename: r for r in engine.documents().collect()}
    assert set(docs) == {"report.txt", "company.csv", "memo.docx", "book.xlsx"} and docs["company.csv"].chunk_count == 3 and docs["memo.docx"].table_count == 1
    chunks = engine.catalog.table("chunks").collect()
    assert all(r.content for r in chunks) and len({r.chunk_id for r in chunks}) == len(chunks)
    summary = next(r.content for r in chunks if r.metadata.get("type") == "summary")
    assert "Revenue: mean: 1766666.67, sum: 5300000.00, min: 1000000.00, max: 2500000.00" in summary
    kinds = {r.entity_type for r in engine.catalog.table("entities").collect()}
    assert {"currency_USD", "percentage_growth", "date", "metric_revenue"} <= kinds
    s = engine.stats()
    assert s["total_documents"] == 4 and s["total_chunks"] == len(chunks) and s["chunk_types"]["metadata"] == 1
    assert engine.catalog.table("embeddings").count() == len(chunks)


def test_questions(engine):
    got = engine.query("What was the total revenue in Q3 2023?")
    assert "$5.3 million" in got["answer"] and got["query_type"] == "aggregation" and 0 < got["confidence"] <= 1 and got["sources"]
    assert "".join(engine.query_stream("What was the total revenue in Q3 2023?")) == got["answer"]
    hello = engine.query("hello")
    assert hello["confidence"] == 1.0 and hello["sources"] == [] and hello["query_type"] == "greeting"
    memo = next(r.document_id for r in engine.documents().collect() if r.filename == "memo.docx")
    only = engine.query("what about expenses", document_ids=[memo])
    assert {s["document_id"] for s in only["sources"]} <= {memo}
    hits = engine.search("revenue growth", top_k=3)
    assert [h["rank"] for h in hits] == [1, 2, 3] and all(len(h["content"]) <= 303 for h in hits)
    assert engine.chunk(hits[0]["chunk_id"])["content"].startswith(hits[0]["content"][:50])
    for bad in ("", "x" * 1001):
        with pytest.raises(errors.ValidationError):
            engine.query(bad)
    with pytest.raises(errors.ValidationError):
        engine.query("revenue", top_k=51)


def test_upload_replace_delete_and_shell(engine):
    up = engine.ingest_bytes("note.txt", REPORT.replace("5.3", "9.9").encode(), '{"a": 1}')
    assert up["custom_metadata"] == {"a": 1} and engine.ingest_bytes("note.txt", REPORT.replace("5.3", "9.9").encode(), "no json")["custom_metadata"] == {}
    assert engine.documents().where(F.col("filename") == "note.txt").count() == 1
    assert engine.catalog.table("chunks").where(F.col("document_id") == up["document_id"]).count() == up["chunk_count"]
    assert "note.txt" in cli.respond(engine, "docs") and cli.respond(engine, "quit") is None and "upload" in cli.respond(engine, "help")
    assert cli.respond(engine, "upload /nowhere.zip").startswith("UNSUPPORTED_FILE_TYPE")
    engine.delete(up["document_id"])
    assert engine.documents().where(F.col("filename") == "note.txt").isEmpty() and engine.catalog.table("chunks").where(F.col("document_id") == up["document_id"]).isEmpty()
    for f in (engine.delete, engine.document):
        with pytest.raises(errors.NotFoundError):
            f(up["document_id"])
    assert cli.respond(engine, f"delete {up['document_id']}").startswith("NOT_FOUND")
    back = engine.ingest_bytes("note.txt", REPORT.replace("5.3", "9.9").encode())
    assert engine.document(back["document_id"])["filename"] == "note.txt"
    engine.delete(back["document_id"])


def test_a_question_reads_stored_postings_of_its_tokens(spark, engine, tmp_path):
    """Stored postings are those of the visible chunks, after deletes, replacements and compaction."""
    up = engine.ingest_bytes("gone.txt", REPORT.replace("5.3", "8.8").encode())
    engine.ingest_bytes("twice.txt", REPORT.replace("5.3", "7.7").encode())
    engine.ingest_bytes("twice.txt", REPORT.replace("5.3", "7.7").encode())
    engine.delete(up["document_id"])
    small = Engine(spark, engine.catalog.compact(f"file://{tmp_path}/c").path)
    asked = spark.createDataFrame([("a", "What was the total revenue?"), ("b", "expenses of the memo")], "query_id string, query string")
    for e in (engine, small):
        stored, fresh = e.corpus().index, bm25.fit(e.catalog.table("chunks"))
        rows = lambda i: sorted(i.postings.select("chunk_id", "token", "tf", "dl").collect())
        assert rows(stored) == rows(fresh) and stored.corpus.collect() == fresh.corpus.collect()
        found = bm25.search(stored, asked, 5)
        got, want = (sorted((r.query_id, r["rank"], r.chunk_id) for r in s.collect()) for s in (found, bm25.search(fresh, asked, 5)))
        assert got == want and got
        plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert re.search(r"/postings\]\s+PushedFilters: \[[^\]]*In\(token", plan) and "/chunks]" not in plan
    engine.delete(next(r.document_id for r in engine.documents().where("filename = 'twice.txt'").collect()))


def test_compaction_and_clear(spark, engine, tmp_path):
    small = engine.catalog.compact(f"file://{tmp_path}/c")
    assert small.table("chunks").count() == engine.catalog.table("chunks").count() and small.raw("tombstones").isEmpty()
    small.clear()
    assert small.table("documents").isEmpty() and Engine(spark, small.path).stats()["total_chunks"] == 0


def test_stream_ingestion(spark, folder, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/cat")
    (tmp_path / "in").mkdir()
    for turn, name in enumerate(["report.txt", "company.csv"]):
        (tmp_path / "in" / name).write_bytes((folder / name).read_bytes())
        watch(e.catalog, f"file://{tmp_path}/in", f"file://{tmp_path}/cp", IngestConfig()).awaitTermination()
        assert e.documents().count() == turn + 1


def test_generation_parts(spark):
    calls = []

    def flaky(q, c, p):
        calls.append(1)
        if len(calls) < 3:
            raise errors.RateLimitError("429") if len(calls) == 1 else ValueError("x")
        return "done"

    waits = []
    assert answering.with_retries(flaky, wait=waits.append)("q", "c", "p") == "done" and waits == [30.0, 5.0]
    with pytest.raises(errors.GenerationError, match="3 tries"):
        answering.with_retries(lambda *a: 1 / 0, wait=lambda s: None)("q", "c", "p")
    row = spark.createDataFrame([("list", "ctx {query}", "que {context}")], "k string, c string, q string").select(answering.prompt(F.col("k"), F.col("c"), F.col("q")).alias("p"), answering.post_processed(F.lit(" a\n\n\n\nb ")).alias("a")).first()
    assert "{n}" in row.p and "ctx {query}" in row.p and row.a == "a\n\nb"
    sure = spark.createDataFrame([([0.8, 0.9], "factual"), ([0.8], "explanation"), ([], "factual"), ([5.0], "trend"), ([-1.0], "trend"), ([0.5] * 5 + [0.0], "list")], "s array<double>, k string")
    assert [round(r.c, 6) for r in sure.select(answering.confidence(F.col("s"), F.col("k")).alias("c")).collect()] == [0.935, 0.72, 0.0, 1.0, 0.0, 0.5]


def test_context_budget(spark):
    hits = spark.createDataFrame([("q", i + 1, f"document-{i}", i if i else None, {"sheet_name": "S"} if i == 1 else None, "x" * 30) for i in range(4)] + [("r", 1, None, None, None, "y")], "query_id string, rank int, document_id string, page_number int, metadata map<string,string>, content string")
    got = {r.query_id: r for r in answering.contexts(hits, 130).collect()}
    assert got["q"].used == 2 and got["q"].context == "[Document: document...]\n" + "x" * 30 + "\n\n---\n\n[Document: document... | Page: 1 | Sheet: S]\n" + "x" * 30
    assert got["r"].context == "[Source]\ny"


def test_evaluation(spark, engine, tmp_path):
    cases = evaluation.example_cases()
    cases.save(f"{tmp_path}/cases.json")
    assert evaluation.EvaluationSet.load(f"{tmp_path}/cases.json") == cases
    assert json.loads((tmp_path / "cases.json").read_text())["name"] == "examples"
    assert evaluation.read_cases(spark, f"file://{tmp_path}/cases.json").count() == len(cases.test_cases)
    cases.test_cases = cases.test_cases[:2]
    scores, report = engine.evaluate(cases)
    assert scores.count() == 2 and {r.level for r in report.collect()} == {"all", "query_type", "difficulty"}
    assert "all: all - 2 cases" in evaluation.printed(report)
    failed = evaluation.run_cases(cases, lambda q: 1 / 0)
    assert all("ZeroDivisionError" in r["error"] for r in failed)
    bad = evaluation.evaluate(evaluation.result_frame(spark, failed)).collect()
    assert all(r.answer_correctness == 0 and r.rouge_1 == 0 for r in bad)
    with pytest.raises(errors.ValidationError):
        evaluation.report(scores.limit(0))


def test_errors():
    e = errors.FileSizeExceededError("too large", size=5)
    assert e.to_dict() == {"error_code": "FILE_SIZE_EXCEEDED", "message": "too large", "details": {"size": 5}} and issubclass(errors.RateLimitError, errors.GenerationError)


def test_a_failed_ingest_is_never_seen_and_a_retry_is_whole(spark, folder, tmp_path, monkeypatch):
    from skein.sources.catalog import Catalog

    e = Engine(spark, f"file://{tmp_path}/c")
    e.ingest(f"file://{folder}/report.txt")
    before = (e.stats(), sorted(r.chunk_id for r in e.catalog.table("chunks").collect()))
    append = Catalog.append

    def fails(self, name, rows, batch):
        if name == "documents":
            raise OSError("lost")
        append(self, name, rows, batch)

    monkeypatch.setattr(Catalog, "append", fails)
    with pytest.raises(OSError):
        e.ingest(f"file://{folder}")
    assert (e.stats(), sorted(r.chunk_id for r in e.catalog.table("chunks").collect())) == before
    monkeypatch.undo()
    for _ in range(2):  # again, and once more over what is there
        e.ingest(f"file://{folder}")
        ids = [r.chunk_id for r in e.catalog.table("chunks").collect()]
        assert e.stats()["total_documents"] == 4 and len(ids) == len(set(ids)) == e.stats()["total_chunks"]
    staged = tmp_path / "c/staging"
    assert len(list(staged.iterdir())) == 1  # of the attempt that failed


def test_large_and_unknown_files_are_not_opened(spark, tmp_path):
    (tmp_path / "big.txt").write_text("x" * 2000)
    (tmp_path / "small.txt").write_text("y")
    (tmp_path / "odd.bin").write_bytes(b"?")
    rows = {r.filename: r for r in files.scan(spark, f"file://{tmp_path}", max_bytes=1000).collect()}
    assert rows["small.txt"].content == b"y" and rows["small.txt"].error is None
    assert rows["big.txt"].content is None and "larger than 1000" in rows["big.txt"].error and rows["odd.bin"].error == "Unsupported file type: bin"
