from __future__ import annotations

import io
import json
import zipfile
from email.message import EmailMessage

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom.sources import files, tables
from caseloom.streaming import events


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


@pytest.fixture
def folder(tmp_path):
    put = lambda name, data: (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    put("a.txt", "plain text")
    put("blank.txt", "  \n")
    put("b.html", "<p>one</p><script>x</script>two")
    put("c.json", json.dumps({"k": {"x": 1}, "l": ["p", None]}))
    put("items_1.json", json.dumps([{"Subject/Title": "S", "Sender": "me", "Email importance": "Normal"}, {"To": "you", "Email importance": "High"}]))
    put("d.csv", "h1,h2\n" + "\n".join(f"{i},v{i}" for i in range(120)))
    put("e.tsv", "h1\th2\n1\t2")
    put("items.csv", "\ufeffSubject/Title,To\nT,u\n")
    put("f.xml", '<r xmlns="urn:x"><a>1</a>tail<b><c>2</c></b></r>')
    put("g.rtf", r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Hello\par W\'f6rld}")
    put("h.docx", office({"word/document.xml": f"<w:document {W}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>para</w:t></w:r></w:p></w:body></w:document>"}))
    put("i.pptx", office({"ppt/slides/slide1.xml": f"<p {A}><a:p><a:r><a:t>slide</a:t></a:r></a:p></p>", "ppt/notesSlides/notesSlide1.xml": f"<p {A}><a:p><a:r><a:t>note</a:t></a:r></a:p></p>"}))
    put("j.xlsx", office({"xl/workbook.xml": f'<workbook {X}><sheets><sheet name="S1"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {X}><si><t>head</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {X}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row/></sheetData></worksheet>'}))
    msg = EmailMessage()
    msg["From"], msg["To"], msg["Subject"], msg["Message-ID"], msg["References"] = "a@x", "b@x", "Hi", "<m1@x>", "<r0@x> <r1@x>"
    msg.set_content("the body")
    msg.add_attachment(b"attached words", maintype="text", subtype="plain", filename="n.txt")
    put("k.eml", msg.as_bytes())
    put("l.zip", office({"in/a.txt": "zipped", "m.zip": office({"deep.txt": "deep", "n.zip": office({"too.txt": "deep"})}), "x.bin": "?"}))
    put("bad.zip", office({"../evil.txt": "x"}))
    put("broken.json", "{")
    put("o.doc", b"\x00\x01This is a legacy document text\x00")
    return tmp_path


def test_all_loaders(spark, folder):
    rows = files.read_documents(spark, f"file://{folder}").collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    text = lambda s: by[s][0]["content"]
    assert text("a.txt") == "plain text" and "blank.txt" not in by
    assert text("b.html").split() == ["one", "two"]
    assert text("c.json") == "k:\nx: 1\nl:\np\n"
    assert [r["content"] for r in by["items_1.json"]] == ["Subject: S\nFrom: me", "To: you\nImportance: High"]
    assert len(by["d.csv"]) == 3 and by["d.csv"][2]["page"] == 3 and by["d.csv"][0]["metadata_extra"]["row_count"] == "120"
    assert text("e.tsv") == "[TABLE]\nh1 | h2\n1 | 2\n[/TABLE]" and text("items.csv") == "Subject: T\nTo: u"
    assert text("f.xml") == "a: 1\ntail\nc: 2" and by["f.xml"][0]["metadata_extra"]["root_tag"] == "r"
    assert text("g.rtf") == "Hello\nWörld"
    assert text("h.docx") == "para\n\n[TABLE]\nx\n[/TABLE]" and text("i.pptx") == "slide\n[NOTES]\nnote\n[/NOTES]"
    assert text("j.xlsx") == "Sheet: S1\n[TABLE]\nhead |  | 5\n[/TABLE]" and "legacy" in text("o.doc")
    mail = by["k.eml"][0]
    assert mail["content"].startswith("From: a@x\nTo: b@x\nSubject: Hi") and mail["content"].endswith("the body")
    assert mail["metadata_extra"]["thread_id"] == "r0@x"
    att = by["k.eml::n.txt"][0]
    assert "attached words" in att["content"] and att["metadata_extra"]["parent_message_id"] == "m1@x"
    assert text("l.zip::a.txt") == "zipped" and text("l.zip::m.zip::deep.txt") == "deep" and not any("too" in s for s in by)
    assert by["bad.zip"][0]["error"] and by["broken.json"][0]["error"]
    report = files.ingestion_report(files.read_documents(spark, f"file://{folder}")).first()
    assert report["files_failed"] == 2 and report["status"] == "PARTIAL"


def test_register_loader():
    @files.register_loader(".own")
    def load_own(name, data):
        return [("own", 1, {}, None)]

    assert files.load_file("x/y.own", b"")[0][3] == "own"
    del files.LOADERS[".own"]


def test_json_sources(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query": "a", "expected_answer_contains": ["k"]}\nnot json\n\n{"query": "b", "expected_sources": ["s"]}\n')
    got = {r["query"]: r for r in tables.read_evaluation_set(spark, f"file://{tmp_path}/q.jsonl").collect()}
    assert got["a"]["keywords"] == ["k"] and got["b"]["expected_sources"] == ["s"] and got["b"]["expected_answer"] == ""
    (tmp_path / "s.json").write_text('[{"name": "n", "num_requests": 2, "num_failures": 0, "avg_response_time": 100.0}]')
    r = tables.read_load_stats(spark, f"file://{tmp_path}/s.json").first()
    assert (r["mean"], r["p95"], r["p99"]) == (0.1, pytest.approx(0.15), 0.2)
    (tmp_path / "audit.jsonl").write_text('{"event_type": "login", "timestamp": "2026-03-05T10:00:00Z"}\n')
    assert tables.read_audit_log(spark, f"file://{tmp_path}/audit.jsonl").first()["ts"] is not None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c-1", 1, "x"), ("c-2", 2, "y")], "case_id string, id long, content string")
    tables.append_chunks(df, f"file://{tmp_path}/chunks")
    assert spark.read.parquet(f"file://{tmp_path}/chunks").where("case_id = 'c-1'").count() == 1
    assert tables.write_records(df, f"file://{tmp_path}/rec", "case_id") == 2
    with pytest.raises(ValueError):
        tables.write_records(df.withColumn("case_id", F.lit("a/b")), f"file://{tmp_path}/rec", "case_id")
    with pytest.raises(ValueError):
        tables.write_records(df, f"file://{tmp_path}/rec", "case_id", most_records=1)
    assert tables.case_namespace("big-Case") == "case_big_case"
    extra = spark.createDataFrame([({"email_from": "a", "attachments": "f", "x": "y"},)], "metadata_extra map<string,string>")
    r = tables.split_extra(extra, ["email_from", "attachment_names"]).first()
    assert (r["email_from"], r["attachment_names"], r["metadata_extra"]) == ("a", "f", {"x": "y"})


def test_stream_dedup_and_windows(spark, tmp_path):
    rows = pd.DataFrame({"event_key": ["a", "b", "a"], "event_type": ["x", "x", "y"], "value": [1.0, 3.0, 5.0], "ts": pd.to_datetime(["2024-01-01 00:00:10", "2024-01-01 00:00:20", "2024-01-01 00:00:30"])})
    schema = "event_key string, event_type string, value double, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    q = events.dedup_events(stream).writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("dedup").count() == 2
    q = events.window_rates(stream, "1 minute", "1 minute").writeStream.format("memory").outputMode("complete").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["event_type"], r["n"]) for r in spark.table("rates").collect()} == {("x", 2), ("y", 1)}


def test_ingest_stream_reads_each_file_once(spark, tmp_path):
    src, sink, check = (f"file://{tmp_path}/{n}" for n in ("src", "sink", "check"))
    for n in (1, 2):
        spark.range(n * 10).write.mode("append").parquet(src)
        q = events.ingest_stream(spark, src, "id long", lambda d: d.withColumn("x", F.col("id") + 1), sink, check)
        q.awaitTermination(60)
    assert spark.read.parquet(sink).count() == 30


def test_breaker():
    state, names = events.CLOSED, []
    for at, ok in [(i, False) for i in range(5)] + [(10, True), (70, True), (71, True), (72, True)]:
        state, name, allowed = events.breaker_step(state, float(at), ok)
        names.append((name, allowed))
    assert names[4] == ("open", True) and names[5] == ("open", False)
    assert names[6] == ("half_open", True) and names[7] == ("closed", True) and names[8] == ("closed", True)
