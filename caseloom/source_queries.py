"""Queries over the loaders, sinks and streams: each writes its files or rows to the shared folder,
reads them back through the operator, and drops the folder once the result is kept."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from email.message import EmailMessage

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.queries import query, table
from caseloom.session import durable, shared_folder
from caseloom.sources import files, tables
from caseloom.streaming import events as streams


class Folder:
    """A new folder below the shared one; gone at the end of the with statement."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, name: str, data: bytes | str) -> None:
        path, fs = self._at(f"{self.path}/{name}")
        out = fs.create(path, True)
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
        out.close()

    def __enter__(self) -> Folder:
        return self

    def __exit__(self, *_) -> None:
        path, fs = self._at(self.path)
        fs.delete(path, True)


def _office(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return out.getvalue()


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _nation_files(folder: Folder, k: int, name: str) -> None:
    """One file of each format for a nation; nations are a table of fixed size."""
    folder.put(f"{k}.txt", f"Nation {name}\nline two")
    folder.put(f"{k}.md", f"# {name}")
    folder.put(f"{k}.log", f"log of {name}")
    folder.put(f"{k}.html", f"<style>p</style><p>{name}</p>x &amp; y")
    folder.put(f"{k}.json", json.dumps({"name": name, "key": k, "list": [1, None]}))
    folder.put(f"items_{k}.json", json.dumps([{"Subject/Title": name, "Sender": "me", "Email importance": "Normal"}]))
    folder.put(f"{k}.csv", f"h1,h2\n{k},{name}\n")
    folder.put(f"{k}.tsv", f"h1\th2\n{k}\t{name}\n")
    folder.put(f"items_{k}.csv", f"Subject/Title,To\n{name},u\n")
    folder.put(f"{k}.xml", f"<r><a>{name}</a><b>{k}</b></r>")
    folder.put(f"{k}.rtf", rf"{{\rtf1\ansi {name}\par {k}}}")
    folder.put(f"{k}.docx", _office(word__document=f"<w:document {_W}><w:body><w:p><w:r><w:t>{name}</w:t></w:r></w:p></w:body></w:document>"))
    folder.put(
        f"{k}.pptx",
        _office(
            ppt__slides__slide1=f"<p {_A}><a:p><a:r><a:t>{name}</a:t></a:r></a:p></p>",
            ppt__notesSlides__notesSlide1=f"<p {_A}><a:p><a:r><a:t>note</a:t></a:r></a:p></p>",
        ),
    )
    folder.put(
        f"{k}.xlsx",
        _office(
            xl__workbook=f'<workbook {_X}><sheets><sheet name="S1"/></sheets></workbook>',
            xl__sharedStrings=f"<sst {_X}><si><t>{name}</t></si></sst>",
            xl__worksheets__sheet1=f'<worksheet {_X}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>{k}</v></c></row></sheetData></worksheet>',
        ),
    )
    mail = EmailMessage()
    mail["From"], mail["To"], mail["Subject"], mail["Message-ID"] = "a@x", "b@x", name, f"<m{k}@x>"
    mail.set_content("the body")
    folder.put(f"{k}.eml", mail.as_bytes())
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr(f"in/z{k}.txt", f"zipped {name}")
    folder.put(f"{k}.zip", packed.getvalue())
    folder.put(f"broken_{k}.json", "{")


_LOADED = {
    "k || '.txt'": r"'Nation ' || name || E'\nline two'", "k || '.md'": "'# ' || name", "k || '.log'": "'log of ' || name",
    "k || '.html'": r"name || E'\nx & y'", "k || '.json'": r"'name: ' || name || E'\nkey: ' || k || E'\nlist:\n1\n'",
    "'items_' || k || '.json'": r"'Subject: ' || name || E'\nFrom: me'", "k || '.csv'": r"E'[TABLE]\nh1 | h2\n' || k || ' | ' || name || E'\n[/TABLE]'",
    "k || '.tsv'": r"E'[TABLE]\nh1 | h2\n' || k || ' | ' || name || E'\n[/TABLE]'", "'items_' || k || '.csv'": r"'Subject: ' || name || E'\nTo: u'",
    "k || '.xml'": r"'a: ' || name || E'\nb: ' || k", "k || '.rtf'": r"name || E'\n' || k", "k || '.docx'": "name",
    "k || '.pptx'": r"name || E'\n[NOTES]\nnote\n[/NOTES]'", "k || '.xlsx'": r"E'Sheet: S1\n[TABLE]\n' || name || ' |  | ' || k || E'\n[/TABLE]'",
    "k || '.eml'": r"E'From: a@x\nTo: b@x\nSubject: ' || name || E'\n\nthe body'", "k || '.zip::z' || k || '.txt'": "'zipped ' || name",
}


@query(
    "WITH n AS (SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation) "
    + " UNION ALL ".join(f"SELECT {source} AS source, {text} AS content, FALSE AS failed FROM n" for source, text in _LOADED.items())
    + " UNION ALL SELECT 'broken_' || k || '.json', NULL, TRUE FROM n"
)
def load_files(spark: SparkSession, d: str) -> DataFrame:
    with Folder(spark, "files") as folder:
        for r in table(spark, d, "nation").collect():  # a table of 25 rows at every size
            _nation_files(folder, r["n_nationkey"], r["n_name"])
        loaded = files.read_documents(spark, folder.path)
        return durable(loaded.select("source", "content", F.col("error").isNotNull().alias("failed")))


@query("SELECT CAST(17 * count(*) AS BIGINT) AS total_files, CAST(16 * count(*) AS BIGINT) AS files_loaded, CAST(count(*) AS BIGINT) AS files_failed, 'PARTIAL' AS status FROM nation")
def ingestion_totals(spark: SparkSession, d: str) -> DataFrame:
    with Folder(spark, "files") as folder:
        for r in table(spark, d, "nation").collect():
            _nation_files(folder, r["n_nationkey"], r["n_name"])
        report = files.ingestion_report(files.read_documents(spark, folder.path))
        return durable(report.select("total_files", "files_loaded", "files_failed", "status"))


@query("SELECT lang AS case_id, doc_id, md5(text) AS text_md5 FROM documents")
def chunk_sink(spark: SparkSession, d: str) -> DataFrame:
    """All documents appended by case and read back."""
    with Folder(spark, "chunks") as folder:
        tables.append_chunks(table(spark, d, "documents").withColumnRenamed("lang", "case_id"), folder.path)
        back = spark.read.parquet(folder.path)
        return durable(back.select(F.col("case_id").cast("string"), "doc_id", F.md5("text").alias("text_md5")))


@query("SELECT 'r-' || o_orderkey AS id, o_totalprice, o_orderpriority FROM orders")
def record_sink(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.concat(F.lit("r-"), "o_orderkey").alias("id"), "o_totalprice", "o_orderpriority")
    with Folder(spark, "records") as folder:
        tables.write_records(rows, folder.path, "id", most_records=1 << 40)
        return durable(spark.read.schema(rows.schema).json(folder.path))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type")
def report_sink(spark: SparkSession, d: str) -> DataFrame:
    report = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))
    with Folder(spark, "report") as folder:
        tables.write_report(report, folder.path)
        return durable(spark.read.schema(report.schema).json(folder.path))


@query("SELECT text AS query, 'src' || (item_id % 3) AS source, CASE WHEN item_id % 2 = 0 THEN 'k' || item_id ELSE '' END AS keywords FROM benchmark")
def evaluation_source(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as JSON lines, with keywords under either name, and broken lines among them."""
    name = F.array(F.concat(F.lit("k"), F.col("item_id").cast("string")))
    rows = table(spark, d, "benchmark").select(
        F.col("text").alias("query"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 3).cast("string"))).alias("expected_sources"),
        F.when(F.col("item_id") % 4 == 0, name).alias("expected_answer_keywords"), F.when(F.col("item_id") % 4 == 2, name).alias("expected_answer_contains"),
    )
    with Folder(spark, "questions") as folder:
        rows.write.json(folder.path)
        folder.put("broken.json", "not json\n\n{\n")
        got = tables.read_evaluation_set(spark, folder.path)
        return durable(got.select("query", F.element_at("expected_sources", 1).alias("source"), F.array_join("keywords", ",").alias("keywords")))


@query(
    """SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS requests, n_nationkey * 12.5 / 1000.0 AS mean, 1.5 * (n_nationkey * 12.5 / 1000.0) AS p95,
    2.0 * (n_nationkey * 12.5 / 1000.0) AS p99 FROM (SELECT n_name, CAST(n_nationkey AS DOUBLE) AS n_nationkey FROM nation)"""
)
def load_test_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").collect()  # a table of 25 rows at every size
    stats = [{"name": r["n_name"], "num_requests": r["n_nationkey"], "num_failures": 0, "avg_response_time": r["n_nationkey"] * 12.5} for r in rows]
    with Folder(spark, "stats") as folder:
        folder.put("stats.json", json.dumps(stats))
        return durable(tables.read_load_stats(spark, folder.path).select("name", "requests", "mean", "p95", "p99"))


@query("SELECT CAST(event_id AS BIGINT) AS event_id, value * 2 AS twice FROM events")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """All events in two drops, each read once by the stream."""
    rows = table(spark, d, "events").select("event_id", "value")
    with Folder(spark, "stream") as folder:
        src, sink, check = (f"{folder.path}/{n}" for n in ("src", "sink", "check"))
        for part in (0, 1):
            rows.where(F.col("event_id") % 2 == part).write.mode("append").parquet(src)
            streams.ingest_stream(spark, src, rows.schema, lambda x: x.select("event_id", (F.col("value") * 2).alias("twice")), sink, check).awaitTermination()
        return durable(spark.read.parquet(sink))


@query("SELECT DISTINCT event_type || '|' || user_id AS event_key FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The keys of all events, each once, through the stream."""
    rows = table(spark, d, "events").select(
        F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("event_key"), F.col("ts").cast("timestamp").alias("ts")
    )
    with Folder(spark, "dedup") as folder:
        src, sink, check = (f"{folder.path}/{n}" for n in ("src", "sink", "check"))
        rows.write.parquet(src)
        streams.ingest_stream(spark, src, rows.schema, lambda x: streams.dedup_events(x, within="3650 days"), sink, check).awaitTermination()
        return durable(spark.read.parquet(sink).select("event_key"))
