"""Oversized texts cut into pieces at natural boundaries.

A text's places where it may be cut form sorted arrays, one for each strength:
after a blank line, after a line, after a sentence mark, beside white space.  With
the prefix sums of sizes a binary search finds the last place under the limit; the
strongest kind that lies in the second half of the piece wins, else the last place
beside white space.  The next piece steps back by at most the overlap, to a place
beside white space, never so far that the following run would no longer fit.  Only a
run without white space that is longer than the limit is cut inside, after a mark that
needs no white space if there is one.

Defined results: null and empty texts give no piece; texts within the limit give one
piece, themselves; white space is kept, so the pieces without their overlaps joined
together are the text.  Repeated rows repeat their pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from quillon.llm.bpe import DEFAULT_VOCABULARY, Encoder

#: First and last code points of the ranges with the Unicode property White_Space.
WHITE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Line ends, marks after which a sentence may end, and those of them that need no white space after them.
LINE_ENDS = "\n\r\u0085\u2028\u2029"
SENTENCE_MARKS = ".!?;:\u2026\u3002\uff01\uff1f\uff1b\u0964\u17d4\u17d5"
CLOSE_MARKS = "\u3002\uff01\uff1f\uff1b\u17d4\u17d5"


def _flags(ranges) -> np.ndarray:
    table = np.zeros(0x3100, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


_WHITE, _LINE = _flags(WHITE), _flags((ord(c), ord(c)) for c in LINE_ENDS)
_MARK, _CLOSE = (np.array(sorted(map(ord, m)), dtype=np.uint32) for m in (SENTENCE_MARKS, CLOSE_MARKS))


def _look(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return table[np.minimum(codes, len(table) - 1)]


def cut_places(text: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """All places beside white space; the strong ones, after blank lines, after lines, after sentence marks; and those after marks inside runs."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    white, line = _look(_WHITE, codes), _look(_LINE, codes)
    line &= ~((codes == 13) & np.append(codes[1:] == 10, False))
    beside = np.flatnonzero(white[:-1] | white[1:]) + 1
    edge = np.diff(np.concatenate(([0], white.view(np.int8), [0])))
    opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = (opens > 0) & (closes < len(codes))
    opens, closes = opens[inner], closes[inner]
    lines = np.concatenate(([0], np.cumsum(line)))
    breaks = lines[closes] - lines[opens]
    marks = np.isin(codes[opens - 1], _MARK)
    inside = np.flatnonzero(np.isin(codes[:-1], _CLOSE) & ~white[1:]) + 1
    return beside, [closes[breaks >= 2], closes[breaks >= 1], closes[marks]], inside


def pieces_of(text: str, limit: int, overlap: int, sizes: np.ndarray | None = None) -> list[tuple[int, int, bool]]:
    """``(start, end, forced)`` of each piece.  ``sizes`` are sizes of the code points (default 1 each)."""
    n = len(text)
    prefix = np.arange(n + 1) if sizes is None else np.concatenate(([0], np.cumsum(sizes)))
    if prefix[-1] <= limit:
        return [(0, n, False)] if n else []
    beside, strong, inside = cut_places(text)
    fit = lambda start: int(np.searchsorted(prefix, prefix[start] + limit, side="right")) - 1  # noqa: E731  the farthest end under the limit
    out: list[tuple[int, int, bool]] = []
    start = cut = 0
    while True:
        far = max(fit(start), cut + 1)
        if far >= n:
            out.append((start, n, False))
            return out
        half = max(cut, start + (far - start) // 2)
        end, forced = far, True
        for places in (*strong, beside):
            i = int(np.searchsorted(places, far, side="right")) - 1
            if i >= 0 and places[i] > (half if places is not beside else cut):
                end, forced = int(places[i]), False
                break
        if forced:
            i = int(np.searchsorted(inside, far, side="right")) - 1
            end = int(inside[i]) if i >= 0 and inside[i] > half else far
        out.append((start, end, forced))
        i = int(np.searchsorted(beside, end, side="right"))
        following = int(beside[i]) if i < len(beside) else n
        back = int(np.searchsorted(prefix, prefix[end] - overlap))
        if prefix[following] - prefix[end] <= limit:  # the next run must still fit
            back = max(back, int(np.searchsorted(prefix, prefix[following] - limit)))
        back = max(back, start + 1)
        i = int(np.searchsorted(beside, back))
        start = int(beside[i]) if i < len(beside) and beside[i] <= end else min(back, end) if forced else end
        cut = end


def _measure(unit: str, path: str):
    """Sizes of a text's code points in ``unit``; none where each counts one."""
    if unit == "code_points":
        return lambda text: None
    if unit == "bytes":
        return lambda text: np.diff(np.concatenate(([0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text]))))
    encoder = Encoder.of(path)
    return encoder.sizes


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int = 1200, overlap: int = 200, with_text: bool = True, unit: str = "code_points", small: bool = True, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(*keys, piece_no, start_pos, end_pos, forced, text_forced[, piece])`` of every text, from one scan.

    ``unit`` is ``code_points``, ``bytes`` (of UTF-8) or ``tokens`` of the byte-level
    vocabulary at ``path``; a piece has the tokens of the whole text that begin in it, so
    encoded alone it may have a few more or less at its ends.  ``forced``: the piece ends
    inside a run without white space; ``text_forced``: one of the text's pieces does.
    Without ``small``, texts within the limit are left out and never leave the JVM.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if unit not in ("code_points", "bytes", "tokens"):
        raise ValueError("unit is code_points, bytes or tokens")
    size = F.char_length if unit == "code_points" else F.octet_length  # a token has a byte at least
    fields = [df.schema[k] for k in keys] + [StructField("piece_no", IntegerType()), StructField("start_pos", LongType()), StructField("end_pos", LongType()), StructField("forced", BooleanType()), StructField("text_forced", BooleanType())]
    schema = StructType(fields + [StructField("piece", StringType())] * with_text)
    names = [f.name for f in schema.fields]

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        """Texts that are their only piece, column by column."""
        n = b.num_rows
        no = pa.array(np.zeros(n, dtype=bool))
        texts = b.column(n_keys)
        tail = [pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), pc.utf8_length(texts).cast(pa.int64()), no, no]
        return pa.RecordBatch.from_arrays([*b.columns[:n_keys], *tail, *([texts.cast(pa.string())] if with_text else [])], names=names)

    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _measure(unit, path)
        for b in batches:
            large = b.column(n_keys + 1)
            if small:
                rest = b.filter(pc.invert(large))
                if rest.num_rows:
                    yield whole(rest)
                b = b.filter(large)
            rows, number, starts, ends, forced, every, texts = [], [], [], [], [], [], []
            for r, value in enumerate(b.column(n_keys).to_pylist()):
                got = pieces_of(value, limit, overlap, measure(value))
                if not small and len(got) == 1:
                    continue
                any_forced = any(p[2] for p in got)
                for k, (s, e, f) in enumerate(got):
                    rows.append(r), number.append(k), starts.append(s), ends.append(e), forced.append(f), every.append(any_forced)
                    if with_text:
                        texts.append(value[s:e])
            head = [c.take(pa.array(rows, pa.int64())) for c in b.columns[:n_keys]]
            tail = [pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(forced, pa.bool_()), pa.array(every, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*head, *tail, *([pa.array(texts, pa.string())] if with_text else [])], names=names)

    value = F.col(text)
    kept = df.where(size(value) > limit) if not small else df.where(value != "")
    return kept.select(*keys, value.alias("_text"), (size(value) > limit).alias("_large")).mapInArrow(run, schema)


def text_fields(nodes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, field, value)``, one row for each named text column of a row, from a single scan."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))
    return nodes.select(F.col(key), F.inline(parts))
