"""Citations of sections and laws in a text.

The text is read once, from left to right, as a row of tokens: lists of clauses and
points, articles, ranges, chapters, and "this ..." words.  Lists wait for the article
that follows them; an article joins what waits to itself and to the law that it stands
by.  Laws are marked beforehand by position and found by bisection.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import product

from quillon.functions.text import _ACCENTED, _PLAIN

#: The word of each level, and the words before it with which it is another word.
LEVEL_WORDS = {"diem_id": "điểm", "khoan_id": "khoản", "dieu_id": "điều", "muc_id": "mục", "chuong_id": "chương", "phan_id": "phần"}
OTHER_WORDS = {
    "diem_id": {"thời", "địa", "đặc", "ưu", "nhược", "quan", "khuyết", "trọng", "nhiệm", "tiêu", "tâm", "nhận", "giao"},
    "khoan_id": {"điều", "tài"},
    "muc_id": {"danh", "hạng", "thư", "chuyên", "tiết"},
    "phan_id": {"thành", "cổ", "một", "đóng"},
}
#: Kinds of law that call themselves "this"; that are cited by number; by name; and that an anchor word leads to.
OWN_LAWS = ("bộ luật", "luật", "nghị định", "thông tư", "quyết định", "pháp lệnh")
NUMBERED_LAWS = ("lệnh", "luật", "nghị quyết", "nghị định", "thông tư", "quyết định")
NAMED_LAWS = ("bộ luật", "luật", "nghị định", "thông tư", "nghị quyết", "hiến pháp")
ANCHORED_LAWS = ("luật", "bộ luật", "nghị định", "thông tư", "quyết định")
ANCHORS = ("của", "theo", "trong", "tại")
#: How far, in characters, an anchor word may stand from a section; lists from their article; a law from one cited by number; an article from "this law".
ANCHOR_REACH, LIST_REACH, LAW_GAP, ARTICLE_REACH = 120, 300, 10, 80
#: Most members of a range of articles and of clauses.
MOST_ARTICLES, MOST_CLAUSES = 500, 100


def _any(words) -> str:
    return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


_INDEX = r"(?:[0-9]{1,3}[a-zđ]?|[a-zđ]{1,2})(?:\.[0-9]{1,3})*(?=[\s,;)]|$)"
_ITEMS = rf"{_INDEX}(?:\s*,\s*{_INDEX})*(?:\s+và\s+{_INDEX})?"
_THIS = _any([*LEVEL_WORDS.values(), *OWN_LAWS])
TOKEN = re.compile(
    rf"từ\s+(?:các\s+)?khoản\s+(?P<low>\d+)\s+đến\s+(?:khoản\s+)?(?P<high>\d+)\s+điều\s+(?P<within>\d+[a-zđ]?)"
    rf"|từ\s+(?:các\s+)?điều\s+(?P<first>\d+)\s+đến\s+(?:điều\s+)?(?P<last>\d+)"
    rf"|\b(?P<list>khoản|điểm)\s+(?P<items>{_ITEMS})"
    rf"|\bđiều\s+(?P<article>\d+[a-zđ]?|này)\b"
    rf"|(?:\bmục\s+(?P<part>[a-zđ0-9.]+)\s+(?:của\s+)?)?\bchương\s+(?P<chapter>[ivxlcdm]+|\d+)\b"
    rf"|(?:(?P<before>\w+)\s+)?\b(?P<this>{_THIS})\s+này\b",
    re.IGNORECASE,
)
_LIST = {w: re.compile(rf"\b{w}\s+({_ITEMS})", re.IGNORECASE) for w in ("khoản", "điểm")}
_OWN = re.compile(rf"\b{_any(OWN_LAWS)}\s+này\b", re.IGNORECASE)
_OWN_NEXT = re.compile(rf"\s*(?:của\s+)?{_any(OWN_LAWS[:4])}\s+này\b", re.IGNORECASE)
_NUMBERED = re.compile(rf"{_any(NUMBERED_LAWS)}\s+[^\n]{{0,60}}?([0-9]+/[0-9a-zđ/\-]+)", re.IGNORECASE)
_NAMED = re.compile(rf"{_any(NAMED_LAWS)}\s+[^\W\d_][^\W\d_\s]*(?:\s+[^\W\d_]+){{0,14}}?(?:\s+năm\s+\d{{4}})?(?=\s*[,.;]|\s+(?:của|được|có|về)\b|\s*$)", re.IGNORECASE)
_ANCHOR = re.compile(rf"\b{_any(ANCHORS)}\s+{_any(ANCHORED_LAWS)}", re.IGNORECASE)
_LAST_WORD = re.compile(r"\w+\s+$")
_FOLD = str.maketrans(_ACCENTED, _PLAIN)
_FORM = re.compile(r"[a-z0-9_.\-]+")


def citation_key(text: str) -> str:
    """Folded, other signs than letters, digits and hyphen as ``_``, none at the ends."""
    return re.sub(r"[^a-z0-9\-]+", "_", text.lower().translate(_FOLD)).strip("_-")


def list_items(word: str, text: str) -> list[str]:
    """Indexes listed after a word: ``khoản 1, 2 và 3`` gives 1, 2, 3."""
    return [x for m in _LIST[word].finditer(text) for x in _split(m[1])]


def _split(items: str) -> list[str]:
    return [x for x in re.split(r"\s*,\s*|\s+và\s+", items) if x]


def _level(word: str) -> str:
    return next((k for k, w in LEVEL_WORDS.items() if w == word), "luat_id")


def self_refs(text: str, context: dict[str, str]) -> list[str]:
    """Ids from the context that the text means by "this article" and the like, by level from the lowest up; not where the word before makes it another word."""
    meant = set()
    for m in re.finditer(rf"(?:(\w+)\s+)?\b({_THIS})\s+này\b", text, re.IGNORECASE):
        level = _level(" ".join(m[2].lower().split()))
        if (m[1] or "").lower() not in OTHER_WORDS.get(level, ()):
            meant.add(level)
    return list(dict.fromkeys(context[k] for k in (*LEVEL_WORDS, "luat_id") if k in meant and context.get(k)))


class Laws:
    """Laws that a text cites, in order of place; its own one if it cites none."""

    def __init__(self, text: str, own: str | None):
        inside = [m.span() for m in _OWN.finditer(text)]
        starts = [s for s, _ in inside]

        def free(place: int) -> bool:
            i = bisect_left(starts, place + 1) - 1
            return i < 0 or place >= inside[i][1]

        found = [(m.start(), citation_key(m[1])) for m in _NUMBERED.finditer(text) if free(m.start())]
        numbered = [p for p, _ in found]
        for m in _NAMED.finditer(text):
            i = bisect_left(numbered, m.start() - LAW_GAP + 1)
            if free(m.start()) and not (i < len(numbered) and numbered[i] < m.start() + LAW_GAP):
                found.append((m.start(), citation_key(m[0])))
        found = sorted(x for x in found if x[1]) or ([(0, own)] if own else [])
        self.places, self.keys, self.text = [p for p, _ in found], [k for _, k in found], text

    def by(self, place: int) -> str | None:
        """The law of a section: the first one from an anchoring word near the section on, else the nearest one."""
        if not self.keys:
            return None
        anchor = _ANCHOR.search(self.text, place, place + ANCHOR_REACH)
        if anchor and (i := bisect_left(self.places, anchor.start())) < len(self.keys):
            return self.keys[i]
        i = bisect_left(self.places, place)
        near = range(max(0, i - 1), min(len(self.keys), i + 1))
        return self.keys[min(near, key=lambda j: abs(self.places[j] - place))]


class _Reading:
    """The state of one reading: what was cited so far, and the lists that wait for an article."""

    def __init__(self, text: str, context: dict[str, str]):
        self.text, self.context = text, context
        self.own = context.get("luat_id") or next((context[k].split(".")[0] for k in LEVEL_WORDS if "." in context.get(k, "")), None)
        self.laws = Laws(text, self.own)
        self.refs: dict[str, None] = {}
        self.waiting: list[tuple[int, str, str]] = []
        self.lists: dict[str, list[str]] = {"khoản": [], "điểm": []}
        self.article_ends: list[int] = []
        self.this: set[str] = set()

    def cite(self, section: str, law: str | None) -> None:
        ref = f"{law}.{section}" if law and not section.startswith(law) else section
        if _FORM.fullmatch(ref.lower()) and "none" not in ref.lower():
            self.refs.setdefault(ref)

    def range_(self, low: str, high: str, most: int, form: str, place: int) -> None:
        a, b = int(low), int(high)
        if a <= b < a + most:
            law = self.laws.by(place)
            for i in range(a, b + 1):
                self.cite(form.format(i), law)

    def list_(self, word: str, items: str, place: int) -> None:
        name = "khoan" if word == "khoản" else "diem"
        for x in _split(items):
            self.lists[word].append(f"{name}_{x.lower().replace('.', '_')}")
            self.waiting.append((place, word, self.lists[word][-1]))

    def article(self, index: str, start: int, end: int) -> None:
        held = {w: [x for p, word, x in self.waiting if word == w and p >= start - LIST_REACH] for w in self.lists}
        self.waiting.clear()
        self.article_ends.append(end)
        section = self.context.get("dieu_id") if index == "này" else f"dieu_{index}"
        if not section:
            return
        law = self.own if _OWN_NEXT.match(self.text, end) else self.laws.by(start)
        below = [".".join(p) for p in product(*(x for x in held.values() if x))]
        for x in below:
            self.cite(f"{section}.{x}" if x else section, law)

    def chapter(self, index: str, part: str | None, start: int, at: int) -> None:
        self.cite(f"chuong_{index}", self.laws.by(at))
        if part:
            self.cite(f"chuong_{index}.muc_{part}", self.laws.by(start))

    def this_(self, word: str, before: str, start: int) -> None:
        level = _level(" ".join(word.split()))
        self.this.add(level)
        if before in OTHER_WORDS.get(level, ()) or level in ("diem_id", "khoan_id", "dieu_id") or not self.context.get(level):
            return
        if level != "luat_id" or not self._article_before(start):
            self.cite(self.context[level], self.own)

    def _article_before(self, start: int) -> bool:
        """Whether an article ends shortly before the word before ``start``."""
        word = _LAST_WORD.search(self.text, max(0, start - ARTICLE_REACH), start)
        border = word.start() if word else start
        return any(border - ARTICLE_REACH < e <= border for e in self.article_ends[-2:])

    def without_article(self) -> None:
        """Lists and "this" words of a text that names no article belong to the context's."""
        clause = self.context.get("khoan_id") if "khoan_id" in self.this else None
        points, clauses = self.lists["điểm"], self.lists["khoản"]
        base = clause if points and clause else self.context.get("dieu_id")
        if base and (points or clauses):
            for x in points or clauses:
                self.cite(f"{base}.{x}", None)
        elif clause:
            self.cite(clause, None)
        elif "diem_id" in self.this and self.context.get("diem_id"):
            self.cite(self.context["diem_id"], None)


def extract_refs(text: str, context: dict[str, str] | None = None) -> list[str]:
    """Ids of the sections that a text cites, in order of place."""
    reading = _Reading(text, context or {})
    for m in TOKEN.finditer(text):
        low = {k: v.lower() for k, v in m.groupdict().items() if v}
        if "within" in low:
            reading.range_(low["low"], low["high"], MOST_CLAUSES, f"dieu_{low['within']}.khoan_{{}}", m.start())
            reading.article_ends.append(m.end())
        elif "first" in low:
            reading.range_(low["first"], low["last"], MOST_ARTICLES, "dieu_{}", m.start())
            reading.article_ends.append(m.end())
        elif "list" in low:
            reading.list_(low["list"], low["items"], m.start())
        elif "article" in low:
            reading.article(low["article"], m.start(), m.end())
        elif "chapter" in low:
            reading.chapter(low["chapter"], low.get("part"), m.start(), m.start("chapter"))
        else:
            reading.this_(low["this"], low.get("before", ""), m.start("this"))
    if not reading.article_ends:
        reading.without_article()
    return list(reading.refs)


# references that a model names


#: Words by which a text cites a whole document, and words whose index it needs to cite a section.
DOCUMENT_WORDS = ("luật", "bộ luật", "nghị định", "thông tư", "quyết định", "nghị quyết", "pháp lệnh")
_WHOLE = re.compile(rf"\b{_any(DOCUMENT_WORDS)}\b", re.IGNORECASE)
_SECTION = re.compile(rf"\b{_any(LEVEL_WORDS.values())}\s+[0-9a-zđ]+", re.IGNORECASE)
#: Levels of a target, outermost first.
TARGETS = ("phan", "chuong", "muc", "dieu", "khoan", "diem")
MOST_CANDIDATE_TEXT = 3000


def cites_whole_document(raw: str | None) -> bool:
    """Whether a text names a document but no section of it."""
    return bool(raw and _WHOLE.search(raw) and not _SECTION.search(raw))


def is_document_key(key: str | None) -> bool:
    """Whether a key can be that of a document: not a bare number, with or without a letter, not a section, and made of several parts or of letters around digits."""
    key = (key or "").lower()
    if re.fullmatch(r"\d{1,3}[a-z]?", key) or re.match(rf"(?:{'|'.join(TARGETS)})_", key):
        return False
    return bool(re.search(r"[_/-]|[a-z].*\d.*[a-z]", key))


def is_junk(ref: str | None) -> bool:
    """Whether a reference does not begin with the key of a document."""
    return not is_document_key((ref or "").split(".")[0])


def model_reference(item: dict, context: dict[str, str] | None = None) -> dict | None:
    """A model's reference ``{raw_text, ref_doc_name, ref_doc_id, is_self_ref, target_ids, confidence}`` with its id; null if it names no document or its id is not one.

    The document is that of ``ref_doc_id``, else of ``ref_doc_name``, else, for a
    self-reference, the context's.  A text that cites a whole document has no targets.
    """
    own = bool(item.get("is_self_ref"))
    document = next((k for k in (citation_key(str(item[n])) for n in ("ref_doc_id", "ref_doc_name") if item.get(n)) if k), None) or ((context or {}).get("luat_id") if own else None)
    named = item.get("target_ids") if isinstance(item.get("target_ids"), dict) else {}
    whole = cites_whole_document(item.get("raw_text"))
    targets = {t: None if whole else _target(named.get(t)) for t in TARGETS}
    ref = ".".join([document or "", *(f"{t}_{v}" for t, v in targets.items() if v)])
    if not document or "none" in ref.lower() or not _FORM.fullmatch(ref.lower()) or is_junk(ref):
        return None
    try:
        confidence = float(item.get("confidence") or 0.0)
    except (TypeError, ValueError):
        confidence = 0.0
    return {"ref_id": ref, "ref_doc_id": document, "target_ids": targets, "is_self_ref": own, "confidence": confidence}


#: What a model writes where it knows no index.
NO_TARGET = ("none", "null", "unknown", "không rõ", "khong ro", "this", "current", "nay", "này", "hien_tai", "hiện tại", "hien tai", "same", "self")


def _target(value: object) -> str | None:
    """The index of a target as a key, dots as ``_``; nothing for document numbers, years and words of not knowing."""
    text = str(value if value is not None else "").strip()
    if text.lower() in ("", *NO_TARGET) or re.search(r"[_/-]|\d{4}", text):
        return None
    return citation_key(text.replace(".", "_")) or None


def merged_candidates(sentences: list[str], most: int = MOST_CANDIDATE_TEXT) -> str:
    """Sentences that may cite, one a line, as the text that a model is asked about: at most ``most`` code points."""
    return "\n".join(sentences)[:most]
