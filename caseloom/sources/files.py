"""Loaders of document files: bytes in, documents out.

One scan of the folder as binary files feeds all loaders: a file's loader is chosen by its
suffix within one Arrow batch function, so a folder of mixed files is read once, in parallel
over files, and a file that fails yields an error row instead of ending the job.  Parsers that
need libraries which are not installed are left out and can be added with register_loader.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_DOCUMENT = 50
ZIP_DEPTH, ZIP_ENTRIES, ZIP_BYTES = 2, 10_000, 500 << 20

#: A document: text, page, extra metadata, and its source where it differs from the file.
Doc = tuple[str, int | None, dict[str, str], str | None]
Loader = Callable[[str, bytes], list[Doc]]
LOADERS: dict[str, Loader] = {}

SCHEMA = (
    "source string, file_type string, page int, content string, metadata_extra map<string,string>, error string"
)


def register_loader(*suffixes: str) -> Callable[[Loader], Loader]:
    """Decorator: use the function for files with these suffixes (with the dot, lower case)."""

    def add(loader: Loader) -> Loader:
        for s in suffixes:
            LOADERS[s] = loader
        return loader

    return add


def _utf8(data: bytes) -> str:
    return data.decode("utf-8-sig", errors="replace")


@register_loader(".txt", ".md", ".log")
def load_text(name: str, data: bytes) -> list[Doc]:
    return [(_utf8(data), 1, {}, None)]


def html_text(html: str) -> str:
    out = re.sub(r"(?is)<script.*?>.*?</script>|<style.*?>.*?</style>", " ", html)
    out = re.sub(r"(?i)<br\s*/?>|</p\s*>", "\n", out)
    out = unescape(re.sub(r"(?s)<[^>]+>", " ", out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", out)).strip()


@register_loader(".html", ".htm")
def load_html(name: str, data: bytes) -> list[Doc]:
    return [(html_text(_utf8(data)), 1, {}, None)]


def flatten_json(value: object, depth: int = 0) -> list[str]:
    """'key: value' lines in the file's order; nested values follow their key's line."""
    if depth >= 50:
        return ["[truncated]"]
    if isinstance(value, dict):
        out: list[str] = []
        for k, v in value.items():
            if isinstance(v, dict | list):
                out += [f"{k}:", *flatten_json(v, depth + 1)]
            else:
                out.append(f"{k}: {'' if v is None else v}")
        return out
    if isinstance(value, list):
        return [line for v in value for line in flatten_json(v, depth + 1)]
    return ["" if value is None else str(value)]


#: Fields of an eDiscovery record and their labels, in order; the first that is
#: filled counts.
RECORD_FIELDS = [
    ("Subject", ("Subject/Title",)), ("From", ("Sender/Author", "Sender")), ("To", ("To",)), ("CC", ("CC",)),
    ("BCC", ("BCC",)), ("Date", ("Date", "Email date sent")), ("Topic", ("Conversation topic",)),
    ("Participants", ("Participants",)), ("Type", ("Message kind",)), ("Attachments", ("Attachment names",)),
    ("Themes", ("Themes list",)), ("Importance", ("Email importance",)),
]


def record_text(record: dict) -> str:
    lines = []
    for label, names in RECORD_FIELDS:
        value = next((str(record[n]).strip() for n in names if record.get(n) and str(record[n]).strip()), "")
        if value and not (label == "Importance" and value.lower() == "normal"):
            lines.append(f"{label}: {value}")
    return "\n".join(lines)


def _is_items(name: str) -> bool:
    return posixpath.basename(name).lower().startswith("items")


@register_loader(".json")
def load_json(name: str, data: bytes) -> list[Doc]:
    value = json.loads(_utf8(data))
    if _is_items(name):
        if not isinstance(value, list):
            raise ValueError("an items file holds an array")
        return [(record_text(r), n + 1, {}, None) for n, r in enumerate(value) if isinstance(r, dict)]
    return [("\n".join(flatten_json(value)), 1, {}, None)]


def _table(rows: Iterator[list[str]], name: str) -> list[Doc]:
    """The header and ROWS_PER_DOCUMENT rows for each document, cells joined by ' | '."""
    header = next(rows, None)
    if header is None:
        return []
    body = [r for r in rows if any(c.strip() for c in r)]
    out: list[Doc] = []
    for at in range(0, len(body), ROWS_PER_DOCUMENT):
        lines = [" | ".join(header), *(" | ".join(r) for r in body[at : at + ROWS_PER_DOCUMENT])]
        out.append(("[TABLE]\n" + "\n".join(lines) + "\n[/TABLE]", at // ROWS_PER_DOCUMENT + 1, {"row_count": str(len(body))}, None))
    return out


@register_loader(".csv")
def load_csv(name: str, data: bytes) -> list[Doc]:
    text = io.StringIO(_utf8(data), newline="")
    if _is_items(name):
        return [(record_text(r), n + 1, {}, None) for n, r in enumerate(csv.DictReader(text))]
    return _table(csv.reader(text), name)


@register_loader(".tsv")
def load_tsv(name: str, data: bytes) -> list[Doc]:
    return _table(csv.reader(io.StringIO(_utf8(data), newline=""), delimiter="\t"), name)


@register_loader(".xml")
def load_xml(name: str, data: bytes) -> list[Doc]:
    if b"<!ENTITY" in data:
        raise ValueError("entity declarations are not read")
    root = ElementTree.fromstring(data)
    local = lambda tag: tag.rsplit("}", 1)[-1]
    lines: list[str] = []

    def walk(node: ElementTree.Element) -> None:
        if node.text and node.text.strip():
            lines.append(f"{local(node.tag)}: {node.text.strip()}")
        for child in node:
            walk(child)
            if child.tail and child.tail.strip():
                lines.append(child.tail.strip())

    walk(root)
    return [("\n".join(lines), 1, {"root_tag": local(root.tag)}, None)]


@register_loader(".rtf")
def load_rtf(name: str, data: bytes) -> list[Doc]:
    text = data.decode("latin-1")
    text = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", " ", text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    text = re.sub(r"\\tab\b ?", "\t", text)
    text = re.sub(r"\\[a-zA-Z]+-?\d* ?", "", text)
    return [(re.sub(r"[{}]|\\\n", "", text).replace("\\", "").strip(), 1, {}, None)]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _rows_block(rows: list[list[str]]) -> str:
    return "[TABLE]\n" + "\n".join(" | ".join(r) for r in rows) + "\n[/TABLE]"


@register_loader(".docx")
def load_docx(name: str, data: bytes) -> list[Doc]:
    """All paragraphs, then all tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    parts = [t for p in body.findall(f"{_W}p") if (t := words(p)).strip()]
    for tbl in body.findall(f"{_W}tbl"):
        parts.append(_rows_block([[words(c).strip() for c in r.findall(f"{_W}tc")] for r in tbl.findall(f"{_W}tr")]))
    return [("\n\n".join(parts), 1, {}, None)]


def _number(path: str) -> int:
    return int(re.search(r"(\d+)\.xml$", path)[1])


@register_loader(".pptx")
def load_pptx(name: str, data: bytes) -> list[Doc]:
    """One document for each slide: text, tables, notes."""
    out: list[Doc] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        para = lambda root: [t for p in root.iter(f"{_A}p") if (t := "".join(x.text or "" for x in p.iter(f"{_A}t"))).strip()]
        for path in sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number):
            root = ElementTree.fromstring(z.read(path))
            tables = list(root.iter(f"{_A}tbl"))
            blocks = [
                _rows_block([["".join(x.text or "" for x in c.iter(f"{_A}t")) for c in r.findall(f"{_A}tc")] for r in t.findall(f"{_A}tr")])
                for t in tables
            ]
            for t in tables:
                t.clear()
            parts = para(root) + blocks
            notes = f"ppt/notesSlides/notesSlide{_number(path)}.xml"
            if notes in names and (text := para(ElementTree.fromstring(z.read(notes)))):
                parts.append("[NOTES]\n" + "\n".join(text) + "\n[/NOTES]")
            out.append(("\n".join(parts), _number(path), {}, None))
    return out


@register_loader(".xlsx")
def load_xlsx(name: str, data: bytes) -> list[Doc]:
    """One document for each sheet; rows without a value are left out."""
    out: list[Doc] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_X}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_X}t")))
        titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number)
        for n, path in enumerate(sheets):
            rows = []
            for row in ElementTree.fromstring(z.read(path)).iter(f"{_X}row"):
                cells: dict[int, str] = {}
                for c in row.findall(f"{_X}c"):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(ch) - 64
                    v = c.find(f"{_X}v")
                    value = v.text or "" if v is not None else "".join(t.text or "" for t in c.iter(f"{_X}t"))
                    cells[at or len(cells) + 1] = shared[int(value)] if c.get("t") == "s" and value else value
                if any(cells.values()):
                    rows.append([cells.get(i, "") for i in range(1, max(cells) + 1)])
            title = titles[n] if n < len(titles) else f"Sheet{n + 1}"
            if rows:
                out.append((f"Sheet: {title}\n{_rows_block(rows)}", n + 1, {"sheet": title}, None))
    return out


@register_loader(".doc")
def load_doc(name: str, data: bytes) -> list[Doc]:
    """Printable text of a legacy document; more than 20 characters or nothing."""
    runs = re.findall(rb"[\x20-\x7e\r\n\t]{4,}", data)
    text = re.sub(r"[\r\n]+", "\n", " ".join(r.decode("ascii") for r in runs)).strip()
    return [(text, 1, {}, None)] if len(text) > 20 else []


#: Extractors of attachments by kind, to be registered where the libraries exist.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {}


def attachment_text(mime: str, payload: bytes, filename: str) -> str:
    """'[ATTACHMENT: f - kind]...[/ATTACHMENT]' or '' where no extractor fits."""
    suffix = posixpath.splitext(filename)[1].lower()
    kind = (
        "image" if mime.startswith("image/") or suffix in (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")
        else "audio" if mime.startswith("audio/") or suffix in (".mp3", ".wav", ".m4a", ".ogg")
        else "pdf" if mime == "application/pdf" or suffix == ".pdf"
        else "text" if mime.startswith("text/") or suffix in (".txt", ".csv", ".md", ".log")
        else ""
    )
    if kind == "text":
        text = _utf8(payload)
    elif kind in EXTRACTORS:
        text = EXTRACTORS[kind](payload)
    else:
        return ""
    return f"[ATTACHMENT: {filename} — {kind}]\n{text.strip()}\n[/ATTACHMENT]" if text.strip() else ""


@register_loader(".eml")
def load_eml(name: str, data: bytes) -> list[Doc]:
    """Headers and text parts, then one more document for each attachment with text."""
    msg = email.message_from_bytes(data, policy=email.policy.default)
    head = [f"{h}: {msg[h]}" for h in ("From", "To", "Cc", "Date", "Subject") if msg[h]]
    bodies: list[str] = []
    files: list[tuple[str, str]] = []
    for part in msg.walk():
        if part.is_multipart():
            continue
        filename = part.get_filename()
        payload = part.get_payload(decode=True) or b""
        if filename or part.get_content_disposition() == "attachment":
            files.append((filename or "attachment", attachment_text(part.get_content_type(), payload, filename or "")))
        elif part.get_content_type() in ("text/plain", "text/html"):
            text = payload.decode(part.get_content_charset() or "utf-8", errors="replace")
            bodies.append(html_text(text) if part.get_content_type() == "text/html" else text.strip())
    clean = lambda v: (v or "").strip().strip("<>")
    refs = (msg["References"] or "").split()
    message_id = clean(msg["Message-ID"])
    meta = {
        "message_id": message_id,
        "thread_id": clean(msg["In-Reply-To"]) or (clean(refs[0]) if refs else ""),
        "email_subject": str(msg["Subject"] or ""), "email_from": str(msg["From"] or ""),
        "email_to": str(msg["To"] or ""), "email_date": str(msg["Date"] or ""),
        "attachment_names": ", ".join(f for f, _ in files),
    }
    out: list[Doc] = [("\n\n".join(["\n".join(head), *[b for b in bodies if b]]).strip(), 1, meta, None)]
    for filename, text in files:
        if text:
            out.append((text, 1, {"parent_message_id": message_id, "attachment_names": filename}, f"{posixpath.basename(name)}::{filename}"))
    return out


@register_loader(".zip")
def load_zip(name: str, data: bytes, depth: int = 0) -> list[Doc]:
    """Documents of all readable entries; an archive with unsafe paths or sizes is refused."""
    out: list[Doc] = []
    base = posixpath.basename(name)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > ZIP_ENTRIES or sum(i.file_size for i in infos) > ZIP_BYTES:
            raise ValueError("the archive is too large")
        for i in infos:
            path = i.filename.replace("\\", "/")
            if path.startswith("/") or ".." in path.split("/") or re.match(r"[A-Za-z]:", path):
                raise ValueError("the archive holds an unsafe path")
        for i in infos:
            suffix = posixpath.splitext(i.filename)[1].lower()
            inner = z.read(i)
            if suffix == ".zip":
                docs = load_zip(i.filename, inner, depth + 1) if depth + 1 < ZIP_DEPTH else []
            elif suffix in LOADERS:
                try:
                    docs = LOADERS[suffix](i.filename, inner)
                except Exception:  # noqa: BLE001  one bad entry does not lose the archive
                    docs = []
            else:
                docs = []
            for text, page, meta, source in docs:
                out.append((text, page, meta | {"archive_source": base}, f"{base}::{source or posixpath.basename(i.filename)}"))
    return out


def load_file(path: str, data: bytes) -> list[tuple[str, str, int | None, str | None, dict[str, str], str | None]]:
    """Rows of SCHEMA for one file; whitespace-only documents are left out."""
    name = posixpath.basename(path)
    suffix = posixpath.splitext(name)[1].lower()
    loader = LOADERS.get(suffix)
    if loader is None:
        return [(name, suffix[1:], None, None, {}, "no loader for this type")]
    try:
        docs = loader(name, data)
    except Exception as e:  # noqa: BLE001  reported as a row
        return [(name, suffix[1:], None, None, {}, f"{type(e).__name__}: {e}"[:500])]
    return [(source or name, suffix[1:], page, text, meta, None) for text, page, meta, source in docs if text and text.strip()]


def read_documents(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """All documents of a folder's files, and one row with an error for each file that failed."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "content")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source", "file_type", "page", "content", "metadata_extra", "error"]
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                out = pd.DataFrame(load_file(path, bytes(data)), columns=names)
                out["page"] = out["page"].astype("Int32")
                yield out

    return files.mapInPandas(run, SCHEMA)


def ingestion_report(loaded: DataFrame) -> DataFrame:
    """One row: files found, loaded and failed, documents, and the status."""
    per_file = loaded.groupBy("source").agg(F.max(F.col("error").isNotNull()).alias("failed"), F.count("content").alias("docs"))
    failed = F.coalesce(F.sum(F.col("failed").cast("long")), F.lit(0))
    return per_file.agg(
        F.count(F.lit(1)).alias("total_files"), (F.count(F.lit(1)) - failed).alias("files_loaded"), failed.alias("files_failed"),
        F.coalesce(F.sum("docs"), F.lit(0)).alias("documents"),
        F.when(failed > 0, "PARTIAL").otherwise("OK").alias("status"),
    )
