"""Sentence boundaries across languages and scripts.

The rules follow the standard property Sentence_Break, whose values are taken from the
``regex`` module: terminators of all scripts (STerm, which always end, and ATerm, full
stops that may be ambiguous), closing quotes and brackets that belong to the end
(Close), and no break where a lower-case letter or a continuing sign (SContinue)
follows.  They are extended by suppression lists of abbreviations for each language, by
labels at the head of a line, by brackets and quotations whose inside is not cut, by
the blanks of Thai and Lao, and by lines: a paragraph's, heading's, item's or table
row's end always breaks, a line end that merely wraps running text does not.

A line end is a wrap if the next line goes on in lower case, or if the document is
wrapped (has such lines) and the next line's first word would not have fitted.

Defined results: positions are code points of the text as stored; null texts and texts
without any letter or digit have no sentence; sentences are trimmed of white space and
cover all else.  Rows are independent.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: Abbreviations by what may follow their period, and by language where they are words in another.
#: Before a name and between parts of a sentence, words in no language: they never end one;
COMMON = frozenset("mr mrs ms dr prof capt sgt lt messrs cf e.g i.e viz vs v approx mm mme mmes mlle mgr c.-à-d p.ex n° tm tl kt tuq uq pgs gs ts ths ks bs ls cn gs.ts pgs.ts ts.bs ths.bs nxb".split())
#: before a name, in one language, never ending a sentence there;
TITLES = {
    "vi": frozenset(),
    "en": frozenset("hon rev gen col".split()),
    "fr": frozenset("me pr".split()),
}
#: before a number or an index letter, in one language, or in any if they begin with a capital: they end a sentence if a word follows.
REFERENCES = {
    "en": frozenset("al art arts sec secs reg regs no nos vol vols pp ch chap fig figs para paras cl ed eds ref".split()),
    "fr": frozenset("al art arts sect ann n no nos vol pp ch chap fig".split()),
    "vi": frozenset(),
}
_SOME_TITLE = frozenset().union(*TITLES.values())
_SOME_REFERENCE = frozenset().union(*REFERENCES.values())
#: Words by which a language is told.
FUNCTION_WORDS = {
    "en": "the of and to is was are he she it his her we they this that with by for shall not under from",
    "fr": "le la les de des du et est un une en dans par sur pour il elle ce cette que qui ne pas au aux",
    "vi": "và của các được có là trong cho theo tại này không khi về những một với đã người phải",
}
_TOLD = {lang: re.compile(rf"\b(?:{'|'.join(words.split())})\b", re.IGNORECASE) for lang, words in FUNCTION_WORDS.items()}
PERSONS = frozenset("ông bà anh chị".split())
ALL_TITLES = COMMON.union(PERSONS, *TITLES.values(), *REFERENCES.values())
#: Those before place names end one only if a sentence, not a name, follows;
PLACES = frozenset("tp tx tt h q p x t đ d kp st ave rd".split())
#: those at the end of a list, time or company name end one if a capital follows.
CLOSING = frozenset("v.v vv etc a.m p.m co ltd inc corp jr sr s.a cie bros".split())
INDEX = re.compile(r"\d|[IVXLC]+\b|[^\W\d_]\b|§")


_EVERY = "".join(map(chr, [*range(0x20000), *range(0xE0000, 0xE1000)]))  # the planes between hold ideographs alone


def _with(sentence_break: str) -> frozenset[str]:
    """All characters with a value of the property Sentence_Break."""
    return frozenset(regex.findall(rf"\p{{Sentence_Break={sentence_break}}}", _EVERY))


#: Terminators that always end, but ! and ?, which have rules of their own, with the Tibetan shad; and full stops that may be ambiguous, but the period.
ALWAYS = _with("STerm") - set("!?") | {"\u0f0d"}
WIDE_STOPS = _with("ATerm") - {"."}
_CLOSE = _with("Close")
#: Brackets by rule: the closing one follows the opening one, or is the next but one; quotation marks that open and close are fixed values.
OPENERS = {c: chr(ord(c) + step) for step in (2, 1) for c in _CLOSE if unicodedata.category(c) == "Ps" and unicodedata.category(chr(ord(c) + step)) == "Pe"}
OPENERS |= {"“": "”", "«": "»", "„": "“", "‹": "›"}
CLOSERS = frozenset(OPENERS.values()) | {"'"} | {c for c in _CLOSE if unicodedata.category(c) in ("Pe", "Pf")}
#: Signs after which the sentence goes on: with Sentence_Break=SContinue, but for dashes, which may open an item or a speech; closing signs; and some symbols.
GOES_ON = {c for c in _with("SContinue") if unicodedata.category(c) != "Pd"} | {c for c in CLOSERS if c not in "'“"} | set(";%、；/=|&\u037e")
_THAI = "\u0e01-\u0e3a\u0e40-\u0e4e"
_LAO = "\u0e81-\u0ebd\u0ec0-\u0ecd\u0edc-\u0edf"

#: Where a sentence may end, or its inside begin or end: brackets and quotation marks, terminators, and blanks between Thai or Lao letters.
_BRACKETS, _ENDS = frozenset(OPENERS) | frozenset(OPENERS.values()) | {'"'}, ALWAYS | WIDE_STOPS | frozenset(".!?…")
_LETTERS = {x: frozenset(re.findall(f"[{x}]", "".join(map(chr, range(0xE00, 0xF00))))) for x in (_THAI, _LAO)}


@lru_cache(maxsize=4096)
def _events(brackets: frozenset[str], ends: frozenset[str], scripts: tuple[str, ...]) -> re.Pattern:
    parts = [f"[{re.escape(''.join(brackets))}]"] * bool(brackets) + [f"[{re.escape(''.join(ends))}]+"] * bool(ends)
    return re.compile("|".join(parts + [rf"(?<=[{x}])[^\S\r\n]+(?=[{x}])" for x in scripts]) or "(?!)")


def events_of(text: str) -> re.Pattern:
    """The pattern of all such places, of what occurs in the text alone: a search among few signs is faster than one among all."""
    seen = set(text)
    return _events(_BRACKETS & seen, _ENDS & seen, tuple(x for x, letters in _LETTERS.items() if not letters.isdisjoint(seen)))
LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
#: What may stand at the head of a line before the text that it belongs to.
LABEL = re.compile(
    r"\s*(?:[-*•+–—]\s+)?(?:(?:điều|khoản|điểm|mục|chương|phần|phụ lục|tiểu mục|article|art|section|sec|chapter|part|chapitre|partie|titre|annexe|schedule|clause|rule)\s+(?:thứ\s+)?[\w.]+|\d+(?:\.\d+)*|[ivxlc]+|[a-zđ]|đ)[.)]?$",
    re.IGNORECASE,
)
ITEM = re.compile(r"\s*(?:[-*•+–—▪◦]\s|\d+(?:\.\d+)*[.)]\s|[a-zđ]\)\s|[IVXLC]+[.)]\s|\([0-9a-zđ]{1,3}\)\s)")
HEADING = re.compile(r"\s*(?:điều|chương|phần|mục|phụ lục|article|section|chapter|part|chapitre|titre)\s+(?:thứ\s+)?[\w.]{1,8}(?:[.:]|\s*$)", re.IGNORECASE)
#: Words whose number follows: a line that ends with one goes on.
COUNTS = re.compile(r"(?:^|\s)(?:phụ lục|phần|chương|bảng|mục|điều|khoản|điểm|tờ|mẫu|hình|số|ngày|từ|đến|mức)$", re.IGNORECASE)
SPEAKER = re.compile(r"\s*[^\W\d_][^:.?!\n]{0,24}:\s")
#: Words before an index letter or number, and what follows the name of someone who speaks.
INDEXED = frozenset("lục bảng tờ mẫu phần chương mục hình phụ schedule annex form table figure".split())
SPEAKS = re.compile(r"\s*(?:trình bày|ghi|nói|phát biểu|khai|said|says|déclare)\b")
INITIALS = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]")
WORD_BEFORE = re.compile(r"[^\s()\[\]{}“”«»「」『』（）\"，、。]*$")
INNER = re.compile(r"(\w\w)[.!?…]+[”»\"')]*\s+(?=[A-ZĐÀ-ỸƠƯĂÂÊÔ])")
FIRST_WORD = re.compile(r"\s*(\S+)")
TWO_WORDS = re.compile("[^\\w]*([^\\W\\d_][\\w\u0300-\u036f\u200b’'-]*)\\.?\\s+[(“\"«]?([^\\W_][\\w\u0300-\u036f\u200b’'-]*)?")
#: A number that opens a sentence: so many days, months, years later.
COUNTED = re.compile(r"\d+\s+(?:ngày|tháng|năm|tuần|giờ|days?|weeks?|months?|years?|jours?|mois|ans|semaines?)\b")
PARTICLES = frozenset("とのをにはがでもやかへなよりまっいう的等和与及之")
_ZERO = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad\u0300-\u036f]")


def _nfc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def _counted(text: str, at: int) -> bool:
    return bool(COUNTED.match(_nfc(text[at : at + 24])))


def _length(line: str) -> int:
    """Printed length: composed, without what prints nothing."""
    return len(line) if line.isascii() else len(_ZERO.sub("", unicodedata.normalize("NFC", line)))


def _tail(line: str) -> int:
    """Printed length from the start of the last sentence in the line."""
    at = 0
    for m in INNER.finditer(line):
        if m[1].islower() or m[1][-1].isdigit():
            at = m.end()
    return _length(line[at:])


def _widths(line: str, following: str, reach: bool) -> range:
    """Widths under which a wrapped text breaks between the two lines."""
    tail = _tail(line)
    if reach:
        return range(max(1, tail - min(_length(line.rsplit(None, 1)[-1]), 30)), tail + 1)
    return range(tail, tail + 1 + min(_length(FIRST_WORD.match(following)[1]), 30))


def _first_letter(text: str, at: int, end: int) -> str:
    """The first letter or digit from ``at``, across blanks, openers and signs, unless a sign comes after which the sentence goes on."""
    for i in range(at, min(end, at + 40)):
        c = text[i]
        if c.isalnum():
            return c
        if c in GOES_ON or c == "<" and text[i : i + 2] == "<|":
            return "" if c != "<" else "a"
    return ""


def _hard_breaks(text: str) -> list[tuple[int, int]]:
    """Stretches of text between line ends that break."""
    lines: list[tuple[int, int]] = []
    at = 0
    for m in LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    if len(lines) == 1:
        return lines
    strip = [_nfc(text[s:e].strip()) for s, e in lines]
    # lines that certainly wrap: the next goes on in lower case and is no item
    sure = [False] * len(lines)
    # a line is as long as fits, or ends with the first word that reaches the width; the rule and width that explain most such lines hold
    votes: dict[tuple[bool, int], int] = {}
    for i in range(len(lines) - 1):
        a, b = strip[i], strip[i + 1]
        if a and b and b[0].islower() and not ITEM.match(b + " ") and " | " not in a and " | " not in b:
            sure[i] = True
            for reach in (False, True):
                for w in _widths(a, b, reach):
                    votes[reach, w] = votes.get((reach, w), 0) + 1
    reach, width = max(votes, key=lambda v: (votes[v], v)) if votes else (False, 0)
    out: list[tuple[int, int]] = []
    start = lines[0][0]
    for i in range(len(lines) - 1):
        a, b = strip[i], strip[i + 1]
        wrap = sure[i]
        if not wrap and width and _tail(a) * 2 >= width and COUNTS.search(a) and re.match(r"\d|[IVXLC]+\b|[A-Z]\b", b):
            wrap = True
        elif not wrap and width and a and b and " | " not in a and " | " not in b and not ITEM.match(b + " "):
            open_end = a[-1] not in ".!?…;:。！？" and not (a[-1] in "”»\"" and a[-2:-1] in ".!?…")
            full = width in _widths(a, b, reach)
            if b[0].isdigit() and open_end and not COUNTED.match(b):
                full = full or _tail(a) * 4 >= width * 3
            heading = HEADING.match(b)
            wrap = full and (open_end and not (heading and (heading.end() >= len(b) or not sure[i - 1])) or not open_end and not heading and not SPEAKER.match(b))
        if not wrap:
            out.append((start, lines[i][1]))
            start = lines[i + 1][0]
    out.append((start, lines[-1][1]))
    return out


class _Language:
    """The language of a stretch of text, told by its function words, else by those of the whole text; looked up only when a word needs it."""

    def __init__(self, text: str, named: str | None):
        self.text, self.named, self.whole = text, named, ""
        self.at, self.here = (-1, -1), ""

    def of(self, start: int, end: int) -> str:
        if self.at != (start, end):
            self.at, self.here = (start, end), self._told(self.text[start:end], 2)
        if not self.here and not self.whole:
            self.whole = self._told(self.text, 1) or (self.named if self.named in TITLES else "") or "en"
        return self.here or self.whole

    @staticmethod
    def _told(text: str, least: int) -> str:
        text = _nfc(text)
        counts = {lang: sum(1 for _ in p.finditer(text)) for lang, p in _TOLD.items()}
        best = max(counts, key=counts.get)
        return best if counts[best] >= least and sorted(counts.values())[-2] < counts[best] else ""


def _period_ends(language: _Language, stretch: tuple[int, int], text: str, start: int, i: int, after: int, following: int, end: int) -> bool:
    """Whether a single period at ``i`` ends the sentence; ``following`` is the next character that is not white."""
    c = text[following]
    word = WORD_BEFORE.search(text, max(start, i - 40), i)[0]
    bare = _nfc(word).strip("-–—*•'’‘<>/").lower()
    if "’" in bare:
        bare = bare.rpartition("’")[2]
    last = word[-1:]
    titles = COMMON | TITLES[language.of(*stretch)] if bare in _SOME_TITLE else COMMON
    if following == after:  # no blank
        if "/" in word or "_" in word or "@" in word or not c.isalpha():
            return c in OPENERS and last.islower() and bare not in titles and len(bare) > 2
        if c.isupper():
            stem = bare.rpartition(".")[2]
            return last.islower() and len(stem) > 1 and bare not in titles and bare not in PLACES and stem not in titles and bare not in CLOSING
        return not c.islower() and last.isalpha() and last.islower() and len(bare) > 2 and bare not in titles and unicodedata.category(c) == "Lo"
    if "ก" <= last <= "ໟ":
        return False
    first = _first_letter(text, following, end)
    if not first and c not in OPENERS and c != '"':
        return c not in GOES_ON and bool(_first_letter(text, following + 1, end))
    if first.islower():
        return False
    if i - start < 40 and LABEL.fullmatch(_nfc(text[start : i + 1])):
        return False
    initial = last.isupper() and bool(INITIALS.fullmatch(bare))
    if bare in titles and not initial:
        return False
    if bare in _SOME_REFERENCE and not initial and INDEX.match(text, following) and (word[0].isupper() or bare in REFERENCES[language.of(*stretch)]):
        return False
    if bare in CLOSING and not initial:
        if first.isdigit():
            return _counted(text, following) or bare in ("v.v", "vv", "etc")
        return not re.match(r"(?:Ltd|Inc|Corp|Co)\b", text[following : following + 5])
    if bare in PLACES or initial:
        if first.isdigit():
            return _counted(text, following)
        before = _nfc(text[max(start, i - len(word) - 14) : i - len(word)]).split()
        if before and before[-1].lower() in INDEXED:
            return True  # an index, not a name
        two = TWO_WORDS.match(text, following, end)
        if two and two[2] and two[2][0].isupper():  # a name, unless one that speaks begins a sentence
            speaks = SPEAKS.match(_nfc(text[two.end() : two.end() + 24]))
            return bool(speaks and before and before[-1].islower())
        if initial and (len(bare) > 1 or before and before[-1].rstrip(".").lower() in ALL_TITLES):
            return False
        return True
    return True


def sentences(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of each sentence; ``lang`` counts where the text does not show its language."""
    out: list[tuple[int, int]] = []
    language = _Language(text, lang)
    places: dict[str, int] = {}

    def follows(sign: str, j: int, end: int) -> bool:
        """Whether ``sign`` comes before ``end``; its last place found is kept, so all searches together read the text once."""
        at = places.get(sign, -1)
        if at < j:
            at = text.find(sign, j)
            places[sign] = at = len(text) if at < 0 else at
        return at < end

    def put(s: int, e: int) -> None:
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            out.append((s, e))

    event = events_of(text)
    for start, end in _hard_breaks(text):
        at = start
        stack: list[str] = []
        for m in event.finditer(text, start, end):
            i, j = m.span()
            c = text[i]
            if j <= at:
                continue
            if c == '"':
                if stack and stack[-1] == '"':
                    c = "close"
                    stack.pop()
                elif follows('"', j, end):
                    stack.append('"')
                    continue
                else:
                    continue
            elif stack and c == stack[-1]:
                stack.pop()
                c = "close"
            elif c in OPENERS:
                if follows(OPENERS[c], j, end):
                    stack.append(OPENERS[c])
                continue
            elif c in CLOSERS:
                if c in stack:
                    del stack[stack.index(c) :]
                    c = "close"
                else:
                    continue
            if stack:
                continue
            if c == "close":
                k = i - 1
                while k > at and text[k].isspace():
                    k -= 1
                if text[k] not in ".!?…" and text[k] not in WIDE_STOPS and text[k] not in ALWAYS:
                    continue
                nxt = j
                while nxt < end and text[nxt].isspace():
                    nxt += 1
                if nxt >= end:
                    continue
                f = text[nxt]
                if f in GOES_ON or f in ".!?…" or f in WIDE_STOPS or f in ALWAYS or f in PARTICLES:
                    continue
                first = _first_letter(text, nxt, end)
                if first.islower() or not first:
                    continue
                round_ = text[i] in ")）]】"
                if round_ and unicodedata.category(first) == "Lo":
                    continue
                put(at, j)
                at = j
                continue
            if c.isspace():  # Thai and Lao
                put(at, i)
                at = j
                continue
            mark = m[0]
            while j < end and (text[j] in CLOSERS or text[j] == '"') and text[j] != "'":
                j += 1
            nxt = j
            while nxt < end and text[nxt].isspace():
                nxt += 1
            if nxt >= end:
                continue
            f = text[nxt]
            if any(x in ALWAYS for x in mark):
                if f in GOES_ON or mark == "។" and text[j : j + 2] == "ល។" or mark == "។" and text[i - 2 : i] == "។ល" and f in GOES_ON:
                    continue
                first = _first_letter(text, nxt, end)
                if first.islower():
                    continue
                ends = True
            elif f in GOES_ON:
                continue
            elif any(x in WIDE_STOPS for x in mark):
                before = text[i - 1 : i]
                if nxt == j and (f.isnumeric() or f.isupper() and (before.isupper() or before.islower())):
                    continue
                ends = not _first_letter(text, nxt, end).islower()
            elif mark == ".":
                ends = _period_ends(language, (start, end), text, at, i, j, nxt, end)
            elif mark[0] == "…" or set(mark) == {"."}:
                first = _first_letter(text, nxt, end)
                ends = first.isupper() or (first.isdigit() and _counted(text, nxt)) or (bool(first) and unicodedata.category(first) == "Lo")
            else:
                first = _first_letter(text, nxt, end)
                if nxt == j and first.isalnum() and first.isascii() and not first.isupper():
                    continue
                ends = bool(first) and not first.islower() or (not first and f not in GOES_ON)
            if ends:
                put(at, j)
                at = j
        put(at, end)
    return out if any(ch.isalnum() for ch in text) else []


def sentence_column(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """``(key, start_pos, end_pos)``: one row for each sentence of each row; ``lang`` is a column that may name the language."""
    schema = StructType([df.schema[key], StructField("start_pos", LongType()), StructField("end_pos", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, ends = [], [], []
            named = b.column(2).to_pylist() if lang else [None] * b.num_rows
            for r, value in enumerate(b.column(1).to_pylist()):
                if value:
                    found = sentences(value, named[r])
                    rows += [r] * len(found)
                    starts += [s for s, _ in found]
                    ends += [e for _, e in found]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[key, "start_pos", "end_pos"])

    return df.select(key, text, *([lang] if lang else [])).mapInArrow(run, schema)
