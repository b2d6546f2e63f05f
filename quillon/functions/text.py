"""Text functions as chains of JVM string expressions.

A chain is a list of steps ``(pattern, replacement)``; a pattern given as
:class:`Literal` is replaced literally.  The same list yields the Spark expression
(:func:`apply`) and the SQL one (:func:`apply_sql`), which another engine evaluates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as Unicode-aware pattern languages see it, spelled out because Java and RE2 mean ASCII by ``\s``.
WHITE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A border of a word, as a group that takes one character or an end.
LEFT, RIGHT = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:$|[^\p{L}\p{M}\p{N}_])"


class Literal(str):
    """A step that replaces a fixed text."""


Steps = list[tuple[str, str]]
STRIP: Steps = [(rf"\A{WHITE}+|{WHITE}+\z", "")]

#: The cleaning steps of converted documents, in their order.
CLEAN: Steps = [
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
    (r"<!--[\s\S]*?-->", ""),
    (rf"(?m)^#+{WHITE}+", ""),
    (r"(?m)^[ \t]*[-*+][ \t]+(\d)", r"\1"),
    (r"(?m)^[ \t]*>[ \t]*", ""),
    (r"(?m)^[ \t]*\|?[-: \|]+\|?[ \t]*$", ""),
    (Literal("|"), ""),
    (r"\*\*(.*?)\*\*", r"\1"),
    (r"\*(.*?)\*", r"\1"),
    (r"__(.*?)__", r"\1"),
    (r"_(.*?)_", r"\1"),
    (r"<[^>]+>", ""),
    (Literal(" "), " "),
    *((Literal("\\" + c), c) for c in "[]<>.-"),
    (rf"{WHITE}+,", ","),
    (rf"{WHITE}+\.", "."),
    (Literal(",."), "."),
    (r"[ \t]+", " "),
    (r"\n[ \t]*\n+", "\n\n"),
    *STRIP,
]
#: HTML by patterns: invisible parts go, block ends become line ends, tags go, the common entities are read.
HTML: Steps = [
    (r"(?is)<(script|style)\b.*?</(?:script|style)>", ""),
    (r"<!--[\s\S]*?-->", ""),
    (r"(?i)</?(?:tr|td|p|div|br|li|h[1-6])\b[^>]*>", "\n"),
    (r"<[^>]+>", " "),
    (Literal("&nbsp;"), " "),
    (Literal("&lt;"), "<"),
    (Literal("&gt;"), ">"),
    (Literal("&amp;"), "&"),
    (r"[ \t]+", " "),
    (r" ?\n[ \n]*", "\n"),
    *STRIP,
]
_ACCENTED, _PLAIN = (
    "àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđ",
    "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd",
)
#: Document type patterns in the order in which they are tried.
TYPES = (("NGHỊ ĐỊNH", "nghi_dinh"), ("NGHỊ QUYẾT", "nghi_quyet"), ("THÔNG TƯ LIÊN TỊCH", "thong_tu_lien_tich"), ("THÔNG TƯ", "thong_tu"), ("QUYẾT ĐỊNH", "quyet_dinh"), ("CHỈ THỊ", "chi_thi"), ("BỘ LUẬT", "bo_luat"), ("LUẬT", "luat"))
#: Numerals.
NUMERALS = {"nhất": "1", "một": "1", "hai": "2", "ba": "3", "bốn": "4", "tư": "4", "năm": "5", "sáu": "6", "bảy": "7", "tám": "8", "chín": "9", "mười": "10", "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
NUMERALS |= {f"mười {w}": str(10 + n) for n, w in enumerate(("một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín"), 1)}
NUMERALS |= {f"{w} mươi": str(10 * n) for n, w in ((2, "hai"), (3, "ba"), (4, "bốn"), (4, "tư"), (5, "năm"), (6, "sáu"), (7, "bảy"), (8, "tám"), (9, "chín"))}
_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: int) -> str:
    out = ""
    for value, sign in _ROMAN:
        out, n = out + sign * (n // value), n % value
    return out


def _romans(upto: int) -> str:
    return "|".join(sorted((roman(i) for i in range(1, upto + 1)), key=len, reverse=True))


#: Heading patterns in the order in which they are tried: type, pattern; group 1 is the index.
HEADINGS = (
    ("phu_luc", rf"(?i)^phụ{WHITE}+lục{WHITE}+(i{{1,3}}|[a-zđ]|\d+)?(?:{WHITE}*[.:)]|$)"),
    ("muc_luc", rf"(?i)^mục{WHITE}+lục(?:{WHITE}*[.:)]|$)()"),
    ("tu_viet_tat", rf"(?i)^(?:danh{WHITE}+mục{WHITE}+)?(?:từ|chữ){WHITE}+viết{WHITE}+tắt(?:{WHITE}*[.:)]|$)()"),
    ("noi_nhan", rf"(?i)^nơi{WHITE}+nhận{WHITE}*[:.]?$()"),
    ("chu_ky", rf"(?i)^(?:kt\.|kí{WHITE}+tên|chữ{WHITE}+ký)(?:{WHITE}|$)()"),
    ("phan", rf"(?i)^phần{WHITE}+thứ{WHITE}+(nhất|một|hai{WHITE}+mươi|hai|ba|bốn|tư|năm|sáu|bảy|tám|chín|mười(?:{WHITE}+[\p{{L}}]+)?)(?:[.:),]|$|{WHITE})"),
    ("phan", rf"(?i)^phần{WHITE}+({_romans(20)}|\d+)(?:[.:),]|$|{WHITE})"),
    ("chuong", rf"(?i)^chương{WHITE}+({_romans(30)}|\d+)(?:[.:),]|$|{WHITE})"),
    ("muc", rf"(?i)^mục{WHITE}+({_romans(30)}|\d+)(?:[.:)]|$|{WHITE})"),
    ("muc_roman", rf"^({_romans(30)})[\\/.)]"),
    *((kind, rf"(?i)^{word}{WHITE}+([0-9a-zđ]+(?:\.[0-9a-zđ]+)*)(?:[.:);]|$|{WHITE})") for kind, word in (("dieu", "điều"), ("khoan", "khoản"), ("diem", "điểm"))),
    ("so_cap_3", r"^(\d+\.\d+\.\d+)[\\.)]?"),
    ("so_cap_2", r"^(\d+\.\d+)[\\.)]?"),
    ("so_cap_1", r"^(\d+)[\\.)]"),
    ("chu_thuong", r"^([a-zđ])[\\.),;]"),
)
#: Texts that may hold a citation.
_KINDS = "điều|khoản|điểm|mục|chương|phần"
_LAWS = f"bộ{WHITE}+luật|luật|nghị{WHITE}+định|thông{WHITE}+tư|quyết{WHITE}+định|nghị{WHITE}+quyết"
REFERENCE = (
    rf"(?i)(?:{LEFT}(?:{_KINDS}){WHITE}+[0-9a-zđ]+(?:\.[0-9a-zđ]+)*{RIGHT}|{LEFT}(?:{_LAWS}|pháp{WHITE}+lệnh){RIGHT}"
    rf"|{LEFT}(?:số{WHITE}+)?\d+/\d{{4}}/[0-9a-zđ/-]+|{LEFT}(?:{_KINDS}|{_LAWS}|văn{WHITE}+bản){WHITE}+này{RIGHT})"
)


def _java(pattern: str) -> str:
    """Java needs Unicode case folding and plain line ends switched on."""
    return ("(?u)" if "(?i" in pattern else "") + "(?d)" + pattern


def apply(text: Column, steps: Steps) -> Column:
    for pattern, to in steps:
        if isinstance(pattern, Literal):
            text = F.replace(text, F.lit(str(pattern)), F.lit(to))
        else:
            text = F.regexp_replace(text, _java(pattern), to.replace("\\1", "$1"))
    return text


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def apply_sql(text: str, steps: Steps) -> str:
    for pattern, to in steps:
        text = f"replace({text}, {quote(pattern)}, {quote(to)})" if isinstance(pattern, Literal) else f"regexp_replace({text}, {quote(pattern)}, {quote(to)}, 'g')"
    return text


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(_java(pattern))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return F.when(matches(text, pattern), F.regexp_extract(text, _java(pattern), group))


def fold(text: Column) -> Column:
    """Lower case without Vietnamese accents, đ as d."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def fold_sql(text: str) -> str:
    return f"translate(lower({text}), '{_ACCENTED}', '{_PLAIN}')"


def format_id(text: Column) -> Column:
    """Citation key: folded, other signs than letters, digits and hyphen as ``_``, none at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9-]+", "_"), "^[_-]+|[_-]+$", ""), F.lit(""))


def format_id_sql(text: str) -> str:
    return f"nullif(regexp_replace(regexp_replace({fold_sql(text)}, '[^a-z0-9-]+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g'), '')"


def slug(text: Column) -> Column:
    """Document key: as :func:`format_id`, but đ and case-folded letters are kept and white space goes."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(text, WHITE + "+", ""), "[^a-zA-Z0-9đĐ-]+", "_")), "^_+|_+$", "")


def slug_sql(text: str) -> str:
    return f"regexp_replace(lower(regexp_replace(regexp_replace({text}, {quote(WHITE + '+')}, '', 'g'), '[^a-zA-Z0-9đĐ-]+', '_', 'g')), '^_+|_+$', '', 'g')"


#: Labels before a document's number.
NUMBER_LABELS = r"nghị\s+định\s+số|thông\s+tư\s+số|nghị\s+quyết\s+số|quyết\s+định\s+số|chỉ\s+thị\s+số|luật\s+số|số".replace(r"\s", WHITE)
#: Where a document's own number stands: pattern and the length of the head in which it is looked for.
NUMBERS = (
    (rf"(?i)số{WHITE}*[:-]?{WHITE}*(\d+{WHITE}*/{WHITE}*vbhn{WHITE}*[-–‑]{WHITE}*vpqh)", 1000),
    (rf"(?i){LEFT}(\d+{WHITE}*/{WHITE}*vbhn{WHITE}*[-–‑]{WHITE}*vpqh){RIGHT}", 1000),
    (rf"(?i)(?:{NUMBER_LABELS}){WHITE}*[:-]?{WHITE}*(\d+/\d{{4}}/[\p{{L}}\p{{N}}_-]+)", 3000),
    (rf"{LEFT}(\d+/\d{{4}}/[\p{{L}}\p{{N}}_-]+)", 3000),
)


def document_number(text: Column) -> Column:
    """A document's own number as a slug, empty if its head shows none."""
    return F.coalesce(*(slug(extract(F.left(text, F.lit(n)), p)) for p, n in NUMBERS), F.lit(""))


def document_number_sql(text: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(left({text}, {n}), {quote(p)}) THEN {slug_sql(f'regexp_extract(left({text}, {n}), {quote(p)}, 1)')} END" for p, n in NUMBERS) + ", '')"


def document_type(text: Column, head: int = 3000) -> Column:
    """Type named by the first short line of the head that names one, else ``unknown``."""

    def of(line: Column) -> Column:
        line = F.upper(apply(line, STRIP))
        found = F.when(F.char_length(line) > 50, None)
        for name, code in TYPES:
            found = found.when(matches(line, LEFT + name.replace(" ", WHITE + "+") + RIGHT), code)
        return found

    codes = F.filter(F.transform(F.split(F.left(text, F.lit(head)), "\n"), of), lambda c: c.isNotNull())
    return F.coalesce(F.try_element_at(codes, F.lit(1)), F.lit("unknown"))


def document_type_sql(text: str, head: int = 3000) -> str:
    line = f"upper({apply_sql('l', STRIP)})"
    cases = " ".join(f"WHEN regexp_matches(u, {quote(LEFT + n.replace(' ', WHITE + '+') + RIGHT)}) THEN '{c}'" for n, c in TYPES)
    return f"coalesce(list_filter(list_transform(list_transform(string_split(left({text}, {head}), chr(10)), lambda l: {line}), lambda u: CASE WHEN length(u) > 50 THEN NULL {cases} END), lambda c: c IS NOT NULL)[1], 'unknown')"


#: Cheap test that every heading passes; most lines fail it and are tried no further.
HEADING_START = r"(?i)^(?:\d|[a-zđ][\\.),;/]|[ivxl]+[\\/.)]|phụ|mục|danh|từ|chữ|nơi|kt\.|kí|phần|chương|điều|khoản|điểm)"


def heading(line: Column) -> Column:
    """``struct(type, idx)`` of a heading line, null for other lines; the index in lower case, dots as ``_``."""
    found = F.when(F.coalesce(line == "", F.lit(True)) | ~matches(line, HEADING_START), F.lit(None))
    for name, pattern in HEADINGS:
        group = F.replace(F.lower(F.regexp_extract(line, _java(pattern), 1)), F.lit("."), F.lit("_"))
        value = F.when(group == "", "1").otherwise(group) if name == "phu_luc" else group
        found = found.when(matches(line, pattern), F.struct(F.lit(name).alias("type"), value.alias("idx")))
    return found


def heading_sql(line: str) -> tuple[str, str]:
    kinds, indexes = [], []
    for name, pattern in HEADINGS:
        p = quote(pattern)
        value = f"replace(lower(regexp_extract({line}, {p}, 1)), '.', '_')"
        value = f"CASE WHEN {value} = '' THEN '1' ELSE {value} END" if name == "phu_luc" else value
        kinds.append(f"WHEN regexp_matches({line}, {p}) THEN '{name}'")
        indexes.append(f"WHEN regexp_matches({line}, {p}) THEN {value}")
    return f"CASE {' '.join(kinds)} END", f"CASE {' '.join(indexes)} END"


def to_number(word: Column) -> Column:
    """A Vietnamese or Roman numeral as digits; anything else stays."""
    table = F.create_map(*(F.lit(x) for pair in NUMERALS.items() for x in pair))
    return F.coalesce(table[F.lower(word)], word)


def to_roman(n: Column) -> Column:
    """Lower-case Roman numeral; numbers below one stay as they are."""
    digits = [[roman(d * 10**e) if d else "" for d in range(10)] for e in range(3)]
    part = lambda e: F.element_at(F.array(*(F.lit(x) for x in digits[e])), F.pmod(F.floor(n / 10**e), F.lit(10)).cast("int") + 1)
    return F.when(n >= 1, F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), part(2), part(1), part(0))).otherwise(n.cast("string"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WHITE + "+"), lambda w: w != ""))


def shorten(text: Column, most: int) -> Column:
    """White space squeezed; beyond ``most`` code points cut and marked by an ellipsis."""
    flat = apply(text, [(WHITE + "+", " "), *STRIP])
    return F.when(F.char_length(flat) > most, F.concat(F.left(flat, F.lit(most - 3)), F.lit("..."))).otherwise(flat)


def word_windows(text: Column, limit: int = 2000, size: int = 1900, overlap: int = 200) -> Column:
    """Texts of more than ``limit`` words as windows of ``size`` words that overlap; others whole."""
    words = F.filter(F.split(text, WHITE + "+"), lambda w: w != "")
    step = size - overlap
    cut = lambda every: F.transform(F.sequence(F.lit(0), F.ceil((F.size(every) - overlap) / step).cast("int") - 1), lambda i: F.array_join(F.slice(every, i * step + 1, F.lit(size)), " "))
    windows = lambda every: F.when(F.size(every) > limit, cut(every)).otherwise(F.array(text))
    return F.element_at(F.transform(F.array(words), windows), 1)


_LISTED = r"(?:[0-9]{1,3}[a-zđ]?|[a-zđ]{1,2})(?:\.[0-9]{1,3})*"


def listed(word: str, text: Column) -> Column:
    """Indexes listed after a word: ``khoản 1, 2 và 3`` gives 1, 2, 3."""
    pattern = rf"(?iuUd)\b{word}\s+({_LISTED}(?:\s*,\s*{_LISTED})*(?:\s+và\s+{_LISTED})?)(?=[\s,;)]|$)"
    lists = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.filter(F.flatten(F.transform(lists, lambda x: F.split(x, r"(?iuUd)\s*,\s*|\s+và\s+"))), lambda x: x != "")


def listed_sql(word: str, text: str) -> str:
    items = f"{_LISTED}(?:{WHITE}*,{WHITE}*{_LISTED})*(?:{WHITE}+và{WHITE}+{_LISTED})?"
    lists = f"regexp_extract_all({text}, '(?i){LEFT}{word}{WHITE}+({items})(?:{WHITE}|[,;)]|$)', 1)"
    return f"list_filter(flatten(list_transform({lists}, lambda x: regexp_split_to_array(x, '(?i){WHITE}*,{WHITE}*|{WHITE}+và{WHITE}+'))), lambda x: x <> '')"


def sliding_chunks(text: Column, size: int, stride: int) -> Column:
    """Windows of ``size`` code points every ``stride``; the last one ends at the text's end."""
    n = F.greatest(F.lit(1), F.ceil((F.char_length(text) - size) / stride).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * stride + 1, F.lit(size)))
