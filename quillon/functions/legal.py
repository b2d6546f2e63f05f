"""Structure of legal texts: functions on one text, run over Arrow batches.

These need match positions or nested state, which Spark's string functions cannot
express.  Each takes a text and gives plain values; :func:`per_text` and
:func:`rows_per_text` turn them into column and table functions.
"""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from quillon.functions import text as T


def _python(pattern: str) -> re.Pattern:
    """A pattern of :mod:`quillon.functions.text` for Python's Unicode-aware engine."""
    return re.compile(pattern.replace(T.WHITE, r"\s").replace(r"[\p{L}]", r"[^\W\d_]").replace(r"[^\p{L}\p{M}\p{N}_]", r"\W"))


def per_text(df: DataFrame, key: str, text: str, function: Callable[[str], object], out: str, kind: str) -> DataFrame:
    """``(key, out)`` with ``function`` of every text that is not null."""
    schema = StructType([df.schema[key], StructField(out, _parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            values = [None if x is None else function(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, to_arrow_type(schema[1].dataType))], names=[key, out])

    return df.select(key, text).mapInArrow(run, schema)


def rows_per_text(df: DataFrame, key: str, text: str, function: Callable[[object, str], list[tuple]], columns: str) -> DataFrame:
    """``(key, *columns)``: the rows that ``function(key, text)`` gives for every text that is not null."""
    tail = _parse_datatype_string(columns)
    schema = StructType([df.schema[key], *tail.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            keys, rows = b.column(0).to_pylist(), []
            for k, value in zip(keys, b.column(1).to_pylist()):
                if value is not None:
                    rows += [(k, *r) for r in function(k, value)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(len(arrow))], schema=arrow)

    return df.select(key, text).mapInArrow(run, schema)


# names and likeness


def normalize_name(text: str) -> str:
    """Without combining marks (đ stays), lower case, single blanks."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(bare.lower().split())


def likeness(a: str, b: str) -> float:
    """Share of matching blocks of two normalized names."""
    return difflib.SequenceMatcher(None, normalize_name(a), normalize_name(b)).ratio()


# model output


def safe_json(text: str) -> str | None:
    """The first object or array that can be read in a model's answer, as compact JSON; null if there is none."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", text):
        try:
            return json.dumps(decoder.raw_decode(text, m.start())[0], ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            continue
    return None


# HTML


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in ("tr", "td", "p", "div"):
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data + " ")


def html_to_text(html: str) -> str:
    """Visible text: line ends after block ends, lines trimmed, blank ones dropped."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(reader.parts).split("\n")) if x)


# chunks


def greedy_pack(text: str, most: int = 200) -> list[str]:
    """Sentences packed into chunks of at most ``most`` words; a longer sentence stands alone."""
    chunks: list[list[str]] = []
    held = 0
    for sentence in (s for s in re.split(r"(?<=[.!?;])\s+", text.strip()) if s):
        n = len(sentence.split())
        if not chunks or held + n > most:
            chunks.append([])
            held = 0
        chunks[-1].append(sentence)
        held += n
    return [" ".join(c) for c in chunks]


def fixed_chunks(text: str, size: int = 1200, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Chunks of at most ``size`` characters: split at the first separator that occurs, small parts merged up to the size with an overlap, large parts split further."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    if len(text) <= size:
        return [text] if text.strip() else []
    level = next(i for i, s in enumerate(separators) if s in text)
    mark, rest = separators[level], separators[level + 1 :]
    parts = [text[i : i + size - overlap] for i in range(0, len(text), size - overlap)] if not mark else [p + mark for p in text.split(mark)[:-1]] + [text.split(mark)[-1]]
    out: list[str] = []
    window: list[str] = []
    for part in parts:
        if len(part) > size:
            if window:
                out.append("".join(window))
            out += fixed_chunks(part, size, overlap, rest)
            window = []
            continue
        if window and sum(map(len, window)) + len(part) > size:
            out.append("".join(window))
            while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(part) > size):
                window.pop(0)
        window.append(part)
    if window:
        out.append("".join(window))
    return [c for c in out if c.strip()]


def oversize_split(text: str, limit: int = 2000, size: int = 1900, overlap: int = 200) -> list[str]:
    """Texts of more than ``limit`` words as windows of ``size`` words that overlap; others whole."""
    words = text.split()
    if len(words) <= limit:
        return [text]
    starts = range(0, max(1, len(words) - overlap), size - overlap)
    return [" ".join(words[s : s + size]) for s in starts]


# document trees

_HEADINGS = [(kind, _python(p)) for kind, p in T.HEADINGS]
_STOPS = frozenset(("phu_luc", "muc_luc", "tu_viet_tat", "noi_nhan", "chu_ky"))
_DIVISIONS = {"phan": 1, "chuong": 2, "muc": 3, "dieu": 4}
_CLAUSES = frozenset(("khoan", "so_cap_1", "so_cap_2", "so_cap_3"))
_POINTS = frozenset(("diem", "chu_thuong"))


@dataclass
class Node:
    """A section of a document; ``level`` is 1 for parts to 6 for points."""

    node_id: str
    kind: str
    level: int
    parent: Node | None = None
    title: str = ""
    content: list[str] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)

    def context(self) -> str:
        up = self.parent
        return "" if up is None else "\n".join(x for x in (up.context(), up.title, ". ".join(up.content)) if x)


def heading(line: str) -> tuple[str, str] | None:
    """Type and index of a heading line."""
    for kind, pattern in _HEADINGS:
        m = pattern.search(line)
        if m:
            index = (m[1] or ("1" if kind == "phu_luc" else "")).lower().replace(".", "_")
            return kind, T.NUMERALS.get(index, index) if kind == "phan" else index
    return None


def parse_tree(document: str, text: str, most: int = 2000) -> list[Node]:
    """Sections of a document in document order.

    A stack holds the open section of every level.  Text goes to the deepest open one;
    parts and chapters take the lines right below their heading into the title.  The first
    kind of numbering seen in an article is its clauses', the first kind of letters its
    points'; other numbering is ordinary text.
    """
    nodes: list[Node] = []
    stack: list[Node] = []
    preamble: list[str] = []
    clause = point = ""
    titled = False

    def open_(kind: str, level: int, index: str, title: str) -> Node:
        while stack and stack[-1].level >= level:
            stack.pop()
        parent = stack[-1] if stack else None
        node = Node(f"{parent.node_id if parent else document}.{kind}_{index}", kind, level, parent, title)
        stack.append(node)
        nodes.append(node)
        return node

    for line in (x.strip() for x in text.split("\n")):
        if not line:
            continue
        found = heading(line)
        kind, index = found or ("", "")
        article = next((n for n in stack if n.level == 4), None)
        if kind in _DIVISIONS:
            open_(kind, _DIVISIONS[kind], index, line)
            titled = kind in ("phan", "chuong")
            clause = point = ""
            if kind == "dieu":
                stack[-1].lines.append(line)
            continue
        if kind in _STOPS:
            stack.clear()
            open_(kind, 1, index or "1", line)
            titled = False
            continue
        if article and kind in _CLAUSES and clause in ("", kind):
            clause, point = kind, ""
            open_("khoan", 5, index, line)
        elif article and kind in _POINTS and point in ("", kind):
            point = kind
            open_("diem", 6, index, line)
        elif not stack:
            preamble.append(line)
            continue
        elif titled:
            stack[-1].title += " : " + line
            continue
        elif not (article and kind in _CLAUSES | _POINTS and stack[-1].level == 4):
            stack[-1].content.append(line)
        for node in stack:
            if node.level >= 4:
                node.lines.append(line)
    heads = [Node(f"{document}.modau_{i}", "mo_dau", 1, None, "", [c]) for i, c in enumerate(greedy_pack(". ".join(preamble), most), 1)] if preamble else []
    return heads + nodes


def flat_chunks(document: str, text: str) -> list[tuple]:
    """``(seq, node_id, kind, parent_id, parent_context, title, content, full_text)`` of the sections; repeated ids are marked."""
    nodes = parse_tree(document, text)
    total: dict[str, int] = {}
    for n in nodes:
        total[n.node_id] = total.get(n.node_id, 0) + 1
    seen: dict[str, int] = {}
    out = []
    for seq, n in enumerate(nodes):
        k = seen[n.node_id] = seen.get(n.node_id, -1) + 1
        own = f"{n.node_id}__dup_{k}" if total[n.node_id] > 1 else n.node_id
        full = "\n".join(n.lines) if n.kind in ("dieu", "khoan") else None
        out.append((seq, own, n.kind, n.parent.node_id if n.parent else document, n.context(), n.title, ". ".join(n.content), full))
    return out
