"""Document files: found with binaryFile, validated on the JVM, parsed a file a time in Arrow batches.

Word and Excel files are read with the standard library (zip and XML); PDF needs the optional pypdf.
A file that cannot be read gives a row with its error and does not stop the others.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.errors import UnsupportedFileTypeError

MAX_BYTES = 50 * 1024 * 1024
TYPES = {"pdf": "pdf", "docx": "docx", "doc": "docx", "xlsx": "xlsx", "xls": "xlsx", "csv": "csv", "txt": "txt"}
UPLOADS = ("pdf", "docx", "xlsx", "csv", "txt")

PARSED = (
    "path string, filename string, file_type string, size long, modified timestamp, sha256 string, error string, pages array<struct<number:int,text:string>>, "
    "tables array<struct<headers:array<string>,rows:array<array<string>>,caption:string,table_index:int,page:int>>, metadata map<string,string>"
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_type(path: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), extension(path))


def mime_matches(content: Column, kind: Column) -> Column:
    """Whether the first bytes fit the type; text types always do."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(kind == "pdf", head == "25504446").when(kind.isin("docx", "xlsx"), head.isin("504B0304", "504B0506", "D0CF11E0")).otherwise(kind.isin("csv", "txt"))


def scan(spark: SparkSession, path: str, recursive: bool = True, extensions: tuple[str, ...] | None = None, stream: bool = False, max_bytes: int = MAX_BYTES, max_files: int = 1000) -> DataFrame:
    """Files of a folder (or one file): path, filename, file_type, size, modified, content, error.  Files of another type or too large are not opened; they have neither content nor sha256."""
    def files(content: bool) -> DataFrame:
        reader = (spark.readStream if stream else spark.read).format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        if stream:
            reader = reader.schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", max_files)
        found = reader.load(path)
        if extensions:
            found = found.where(extension(F.col("path")).isin([e.lower().lstrip(".") for e in extensions]))
        kind, name = file_type(F.col("path")), F.regexp_extract("path", r"([^/]+)$", 1)
        known = ["path", name.alias("filename"), kind.alias("file_type"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
        fits = kind.isNotNull() & (F.col("length") <= max_bytes)
        if content:
            wrong = F.when(~mime_matches(F.col("content"), kind), F.concat(F.lit("Content is not of type "), kind))
            return found.where(fits).select(*known, F.when(wrong.isNull(), F.col("content")).alias("content"), F.sha2("content", 256).alias("sha256"), wrong.alias("error"))
        # the filter on length reaches the reader, and no content is asked for: these files are not opened
        large = F.concat(F.lit("File is larger than "), F.lit(max_bytes).cast("string"), F.lit(" bytes"))
        error = F.when(kind.isNull(), F.concat(F.lit("Unsupported file type: "), extension(F.col("path")))).otherwise(large)
        return found.where(~fits).select(*known, F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("sha256"), error.alias("error"))

    return files(True).unionByName(files(False))


def document_id(filename: Column, sha256: Column) -> Column:
    """The same file under the same name is the same document."""
    return F.sha2(F.concat(filename, F.lit(":"), sha256), 256)


# -- parsers: bytes to (pages, tables, metadata)

Parsed = tuple[list[tuple[int, str]], list[tuple[list, list, str | None, int | None]], dict[str, str]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def decode(content: bytes, encoding: str = "utf-8") -> str:
    return content.decode(encoding, "replace").removeprefix("﻿")


def sniff_delimiter(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample[:8192]).delimiter
    except csv.Error:
        return ","


def _properties(z: zipfile.ZipFile) -> dict[str, str]:
    if "docProps/core.xml" not in z.namelist():
        return {}
    out = {}
    for e in ElementTree.fromstring(z.read("docProps/core.xml")):
        name = e.tag.rpartition("}")[2]
        if name in ("title", "creator", "created", "modified") and e.text:
            out["author" if name == "creator" else name] = e.text
    return out


def parse_docx(content: bytes) -> Parsed:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
        paragraphs = [t for p in body.findall(f"{_W}p") if (t := text(p)).strip()]
        tables = []
        for t in body.findall(f"{_W}tbl"):
            rows = [["\n".join(text(p) for p in c.findall(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
            if rows:
                tables.append((rows[0], rows[1:], None, None))
        return [(1, "\n\n".join(paragraphs))], tables, _properties(z) | {"paragraphs": str(len(paragraphs))}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_xlsx(content: bytes) -> Parsed:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        links = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        tables = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            grid = []
            for r in ElementTree.fromstring(z.read(f"xl/{links[sheet.get(f'{_R}id')]}")).iter(f"{_S}row"):
                row: list[str | None] = []
                for i, c in enumerate(r.findall(f"{_S}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    row += [None] * (at + 1 - len(row))
                    v, kind = c.find(f"{_S}v"), c.get("t")
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else None if v is None else v.text
                    row[at] = shared[int(value)] if kind == "s" and value is not None else value
                grid.append(row)
            if grid:
                width = max(map(len, grid))
                grid = [r + [None] * (width - len(r)) for r in grid]
                tables.append(([(h or "").strip() for h in grid[0]], grid[1:], sheet.get("name"), None))
        sheets = [t[2] for t in tables]
        return [], tables, _properties(z) | {"sheet_count": str(len(sheets)), "sheet_names": ",".join(sheets)}


def parse_csv(content: bytes, encoding: str = "utf-8", delimiter: str | None = None) -> Parsed:
    text = decode(content, encoding)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter or sniff_delimiter(text)) if r]
    if not rows:
        return [], [], {}
    body = [[c if c != "" else None for c in r] for r in rows[1:]]
    return [], [([h.strip() for h in rows[0]], body, None, None)], {"row_count": str(len(body)), "column_count": str(len(rows[0]))}


def parse_txt(content: bytes, encoding: str = "utf-8") -> Parsed:
    text = decode(content, encoding)
    return [(1, text)], [], {"line_count": str(text.count("\n") + 1), "char_count": str(len(text)), "word_count": str(len(text.split()))}


def parse_pdf(content: bytes) -> Parsed:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise UnsupportedFileTypeError("PDF files need the optional package pypdf") from e
    reader = PdfReader(io.BytesIO(content))
    info = reader.metadata or {}
    metadata = {k: str(info[f"/{n}"]) for k, n in (("title", "Title"), ("author", "Author"), ("subject", "Subject"), ("creator", "Creator")) if info.get(f"/{n}")}
    return [(i, p.extract_text() or "") for i, p in enumerate(reader.pages, 1)], [], metadata | {"page_count": str(len(reader.pages))}


#: Extend with a parser of one's own: a type's name and a function from bytes to (pages, tables, metadata).
PARSERS: dict[str, Callable[[bytes], Parsed]] = {"pdf": parse_pdf, "docx": parse_docx, "xlsx": parse_xlsx, "csv": parse_csv, "txt": parse_txt}


def get_parser(extension_or_type: str) -> Callable[[bytes], Parsed]:
    kind = TYPES.get(extension_or_type.lower().lstrip("."), extension_or_type)
    if kind not in PARSERS:
        raise UnsupportedFileTypeError(f"Unsupported file type: {extension_or_type}", supported=sorted(TYPES))
    return PARSERS[kind]


def parse(files: DataFrame) -> DataFrame:
    """scan()'s rows parsed: pages, tables and metadata, or an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                pages, tables, metadata, error = [], [], {}, r.error
                if error is None:
                    try:
                        pages, tables, metadata = get_parser(r.file_type)(r.content)
                    except Exception as e:  # noqa: BLE001  one file's failure is its row's
                        error = f"{type(e).__name__}: {e}"
                out.append((r.path, r.filename, r.file_type, r.size, r.modified, r.sha256, error, [{"number": n, "text": t} for n, t in pages], [{"headers": list(h), "rows": [[None if c is None else str(c) for c in row] for row in rows], "caption": cap, "table_index": i, "page": p} for i, (h, rows, cap, p) in enumerate(tables)], metadata))
            yield pd.DataFrame(out, columns=["path", "filename", "file_type", "size", "modified", "sha256", "error", "pages", "tables", "metadata"])

    return files.select("path", "filename", "file_type", "size", "modified", "sha256", "error", "content").mapInPandas(run, PARSED)


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", delimiter: str | None = None) -> DataFrame:
    """One CSV as a DataFrame, types inferred, names trimmed; the delimiter sniffed from the file's head."""
    if delimiter is None:
        head = spark.read.text(path).limit(50).collect()
        delimiter = sniff_delimiter("\n".join(r.value for r in head))
    df = spark.read.option("header", True).option("inferSchema", True).option("sep", delimiter).option("encoding", encoding).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def text_stats(text: Column) -> Column:
    """struct(line_count, char_count, word_count)."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.struct(lines.cast("long").alias("line_count"), F.length(text).cast("long").alias("char_count"), F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))).cast("long").alias("word_count"))
