"""File sources and sinks: Parquet, CSV, JSON lines, JSON arrays, folders of binary files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.store import ordinal
from quillon.session import _base

COUNTS = "co_quan_ban_hanh string, count bigint"
EXTENSIONS = ("pdf", "docx", "doc", "html", "txt", "md")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{_base(spark).rstrip('/')}/quillon/{name}-{uuid.uuid4().hex[:12]}"


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of names and counts; rows that do not fit are left out."""
    return spark.read.schema(COUNTS).option("header", True).option("mode", "DROPMALFORMED").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line, blank lines skipped."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def shard(rows: DataFrame, key: str, parts: int, part: int, done: int = 0) -> DataFrame:
    """The ``part``-th of ``parts`` positional shards in the order of an integer key; the last takes the remainder.  A shard that is taken up again leaves out its first ``done`` rows.

    Positions come from block counts, so no task sorts the whole table.
    """
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    placed = ordinal(rows.withColumn("_all", F.lit(0)), "_all", key, "_n")
    size = F.expr(f"_total div {parts}")
    last = F.lit(True) if part == parts - 1 else F.col("_n") - 1 < size * (part + 1)
    return placed.crossJoin(F.broadcast(total)).where((F.col("_n") - 1 >= size * part + done) & last).drop("_all", "_n", "_total")  # total is one row


def read_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``(path, folder, extension, content)`` of the files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = found.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), "content")
    return named.where(F.col("extension").isin(*extensions))


def extract_text(found: DataFrame, extractors: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """``(path, text, error)``: each file read by the extractor of its extension; what fails is a row with an error, not a failed job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for extension, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    if extension not in extractors:
                        raise ValueError(f"no extractor for .{extension}")
                    texts.append(extractors[extension](content))
                    errors.append(None)
                except Exception as problem:  # noqa: BLE001  reported in the row
                    texts.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return found.select("path", "extension", "content").mapInArrow(run, "path string, text string, error string")


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX file, by the standard library alone."""
    return docx_blocks(content, marks=False)


def docx_markdown(content: bytes) -> str:
    """A DOCX file as marked-up text: headings, list items, and tables as rows of cells between bars."""
    return docx_blocks(content, marks=True)


def docx_blocks(content: bytes, marks: bool) -> str:
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    raw = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8")
    if "xmlns:w=" not in raw:  # fragments without the usual name
        raw = re.sub(r"<w:document\b", f'<w:document xmlns:w="{W[1:-1]}"', raw, count=1)
    body = ElementTree.fromstring(raw)
    signs = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}

    def text_of(node) -> str:
        return "".join(x.text or "" if x.tag == f"{W}t" else signs.get(x.tag, "") for x in node.iter())

    def paragraph(node) -> str:
        text = text_of(node)
        if not marks or not text.strip():
            return text
        style = node.find(f"{W}pPr/{W}pStyle")
        level = re.fullmatch(r"(?:Heading|heading ?)(\d)", style.get(f"{W}val", "") if style is not None else "")
        if level:
            return "#" * int(level[1]) + " " + text
        return "- " + text if node.find(f"{W}pPr/{W}numPr") is not None else text

    def row(node) -> str:
        return " | ".join(" ".join(text_of(cell).split()) for cell in node.findall(f"{W}tc"))

    def walk(node):
        for child in node:
            if child.tag == f"{W}p":
                yield paragraph(child)
            elif child.tag == f"{W}tbl":
                yield from (f"| {r} |" if marks else r for r in map(row, child.findall(f"{W}tr")))
            else:
                yield from walk(child)

    return "\n".join(walk(body))


def pdf_text(content: bytes) -> str:
    """Text of a PDF file by an installed reader, else of its plain text streams; a file whose fonts need a reader is an error."""
    try:
        import io

        import pypdf

        return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages)
    except ImportError:
        text = pdf_streams(content)
    if not text.strip():
        raise ValueError("no text that can be read without a PDF reader")
    return text


def pdf_streams(content: bytes) -> str:
    """Strings that the page streams of a PDF file show, a line for each text block."""
    import re
    import zlib

    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    lines = []
    for m in re.finditer(rb"<<((?:[^<>]|<<.*?>>|<[^<>]*>)*)>>\s*stream\r?\n(.*?)\r?\nendstream", content, re.S):
        data = m[2]
        if b"FlateDecode" in m[1]:
            try:
                data = zlib.decompress(data)
            except zlib.error:
                continue
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", data, re.S):
            shown = [_pdf_string(x) for x in re.findall(rb"\((?:\\.|[^\\()])*\)", block, re.S)]
            lines.append("".join(shown))
    return "\n".join(x for x in lines if x)


def _pdf_string(raw: bytes) -> str:
    import re

    signs = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else signs.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return plain[2:].decode("utf-16-be", "replace") if plain.startswith(b"\xfe\xff") else plain.decode("cp1252", "replace")


def by_command(command: list[str]) -> Callable[[bytes], str]:
    """An extractor that hands the file to an installed program on its standard input and takes what it prints."""

    def run(content: bytes) -> str:
        import shutil
        import subprocess

        if not shutil.which(command[0]):
            raise RuntimeError(f"{command[0]} is not installed")
        done = subprocess.run(command, input=content, capture_output=True, timeout=300)
        if done.returncode:
            raise RuntimeError(done.stderr.decode(errors="replace")[:500])
        return done.stdout.decode("utf-8", "replace")

    return run


TEXT_EXTRACTORS: dict[str, Callable[[bytes], str]] = {"txt": lambda c: c.decode("utf-8"), "md": lambda c: c.decode("utf-8"), "html": lambda c: c.decode("utf-8"), "docx": docx_text}
#: As :data:`TEXT_EXTRACTORS`, with marked-up DOCX, PDF and, where the program is there, DOC.
MARKED_EXTRACTORS = TEXT_EXTRACTORS | {"docx": docx_markdown, "pdf": pdf_text, "doc": by_command(["antiword", "-"])}


def extract_clean(found: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """:func:`extract_text` with marked-up texts and the cleaning steps of converted documents."""
    read = extract_text(found, extractors or MARKED_EXTRACTORS)
    return read.withColumn("text", T.apply(F.col("text"), T.CLEAN))


def refuse_unknown(path: str, extractors: dict[str, Callable[[bytes], str]] | None = None) -> Callable[[bytes], str]:
    """The extractor of one file's type; a type that has none is an error."""
    extension = path.rpartition(".")[2].lower()
    made = (extractors or MARKED_EXTRACTORS).get(extension)
    if made is None:
        raise ValueError(f"no extractor for .{extension}")
    return made


def read_jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, low: int | None = None, high: int | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A database table; with an integer column and its bounds it is read in that many parts."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if column is not None:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def read_query(given: str) -> str:
    """A question as given, or, after ``@file:``, the text of a file."""
    if not given.startswith("@file:"):
        return given
    with open(given.removeprefix("@file:").strip(), encoding="utf-8") as f:
        return f.read().strip()
