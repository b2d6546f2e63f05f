"""Agency, dates and other data read off a document's text, as JVM expressions.

Defined results: a null text gives null; what is not found is empty.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as T

#: Agencies in the order in which they are looked for, and how they are shown.
AGENCIES = (
    ("QUỐC HỘI", "Quốc Hội"),
    ("ỦY BAN THƯỜNG VỤ QUỐC HỘI", "Ủy Ban Thường Vụ Quốc Hội"),
    ("THỦ TƯỚNG CHÍNH PHỦ", "Thủ Tướng Chính Phủ"),
    ("BỘ TÀI CHÍNH", "Bộ Tài Chính"),
    ("BỘ TƯ PHÁP", "Bộ Tư Pháp"),
    ("BỘ CÔNG AN", "Bộ Công An"),
    ("BỘ QUỐC PHÒNG", "Bộ Quốc Phòng"),
    ("BỘ Y TẾ", "Bộ Y Tế"),
    ("BỘ GIÁO DỤC VÀ ĐÀO TẠO", "Bộ Giáo Dục Và Đào Tạo"),
    ("BỘ KẾ HOẠCH VÀ ĐẦU TƯ", "Bộ Kế Hoạch Và Đầu Tư"),
    ("BỘ CÔNG THƯƠNG", "Bộ Công Thương"),
    ("BỘ LAO ĐỘNG", "Bộ Lao Động - Thương Binh Và Xã Hội"),
    ("BỘ NÔNG NGHIỆP", "Bộ Nông Nghiệp Và Phát Triển Nông Thôn"),
    ("BỘ GIAO THÔNG VẬN TẢI", "Bộ Giao Thông Vận Tải"),
    ("BỘ XÂY DỰNG", "Bộ Xây Dựng"),
    ("BỘ TÀI NGUYÊN VÀ MÔI TRƯỜNG", "Bộ Tài Nguyên Và Môi Trường"),
    ("BỘ THÔNG TIN VÀ TRUYỀN THÔNG", "Bộ Thông Tin Và Truyền Thông"),
    ("BỘ NGOẠI GIAO", "Bộ Ngoại Giao"),
    ("BỘ NỘI VỤ", "Bộ Nội Vụ"),
    ("BỘ VĂN HÓA", "Bộ Văn Hóa, Thể Thao Và Du Lịch"),
    ("BỘ KHOA HỌC VÀ CÔNG NGHỆ", "Bộ Khoa Học Và Công Nghệ"),
    ("CHÍNH PHỦ", "Chính Phủ"),
    ("NGÂN HÀNG NHÀ NƯỚC", "Ngân Hàng Nhà Nước"),
    ("KIỂM TOÁN NHÀ NƯỚC", "Kiểm Toán Nhà Nước"),
    ("VIỆN KIỂM SÁT NHÂN DÂN TỐI CAO", "Viện Kiểm Sát Nhân Dân Tối Cao"),
    ("TÒA ÁN NHÂN DÂN TỐI CAO", "Tòa Án Nhân Dân Tối Cao"),
    ("ỦY BAN NHÂN DÂN", "Ủy Ban Nhân Dân"),
    ("HỘI ĐỒNG NHÂN DÂN", "Hội Đồng Nhân Dân"),
)
#: A written day; what stands before the day of issue, of adoption, and of coming into force; headings of final articles; and how far texts are read.
DAY = r"\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
ISSUED = r"(?:Hà\s+Nội|TP\.?\s*Hồ\s+Chí\s+Minh|[A-ZĐÁÀẢÃẠ]\w+),?\s*ngày"
ADOPTED = r"thông\s+qua\s+ngày"
IN_FORCE = (
    r"có\s+hiệu\s+lực\s+(?:thi\s+hành\s+)?(?:từ\s+ngày|kể\s+từ\s+ngày)",
    r"hiệu\s+lực\s+(?:từ\s+ngày|kể\s+từ\s+ngày)",
    r"(?:thi\s+hành|áp\s+dụng)\s+(?:từ\s+ngày|kể\s+từ\s+ngày)",
)
FROM_SIGNING = r"có\s+hiệu\s+lực\s+kể\s+từ\s+ngày\s+ký"
FINAL_ARTICLE = (
    r"^Điều\s+\d+[a-z]?\.\s+"
    r"(?:(?:Điều\s+khoản\s+)?hiệu\s+lực\s+thi\s+hành"
    r"|(?:Điều\s+khoản\s+)?hiệu\s+lực\s+v[àa]\s+(?:\w+\s+)?thi\s+hành"
    r"|Điều\s+khoản\s+thi\s+hành"
    r"|Tổ\s+chức\s+thực\s+hiện"
    r"|Trách\s+nhiệm\s+thi\s+hành)[^\n]*"
)
AGENCY_HEAD, ISSUE_HEAD, FINAL_WINDOW = 100, 4000, 1000

_JAVA = "(?iuUd)"  # letters, digits and white space of all scripts; plain line ends


def agency(text: Column) -> Column:
    """The first listed agency that the head of the text names."""
    head = F.upper(F.left(text, F.lit(AGENCY_HEAD)))
    found = F.when(text.isNull(), F.lit(None).cast("string"))
    for keyword, shown in AGENCIES:
        found = found.when(F.contains(head, F.lit(keyword)), shown)
    return found.otherwise("")


def _day(text: Column, before: str) -> Column:
    """The first day after the words ``before`` as dd/MM/yyyy, null if there is none."""
    part = lambda g: F.regexp_extract(text, _JAVA + before + DAY, g)
    return F.when(part(3) != "", F.concat_ws("/", F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"), part(3)))


def issue_date(text: Column) -> Column:
    """Day of issue: after a place in the head, else the day of adoption."""
    return F.when(text.isNotNull(), F.coalesce(_day(F.left(text, F.lit(ISSUE_HEAD)), ISSUED), _day(text, ADOPTED), F.lit("")))


def effective_date(text: Column) -> Column:
    """Day from which the text is in force: named below its final articles, in their order, else anywhere, else the day of issue if it says so."""
    first_of = lambda scope: F.coalesce(*(_day(scope, p) for p in IN_FORCE))
    scopes = F.regexp_extract_all(text, F.lit(f"(?m){_JAVA}{FINAL_ARTICLE}(?=([\\s\\S]{{0,{FINAL_WINDOW}}}))"), F.lit(1))
    named = F.try_element_at(F.filter(F.transform(scopes, first_of), lambda d: d.isNotNull()), F.lit(1))
    signing = F.when(text.rlike(_JAVA + FROM_SIGNING), issue_date(text))
    return F.when(text.isNotNull(), F.coalesce(named, first_of(text), signing, F.lit("")))


# the same in SQL, from the same fixed values: final articles by the places of their headings


def _re2(pattern: str) -> str:
    wide = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    return "'(?i)" + pattern.replace(r"\w", r"[\p{L}\p{M}\p{N}_]").replace(r"[\s\S]", r"(?s:.)").replace(r"\s", wide) + "'"


def _day_sql(text: str, before: str) -> str:
    g = lambda i: f"regexp_extract({text}, {_re2(before + DAY)}, {i})"
    return f"CASE WHEN {g(3)} <> '' THEN lpad({g(1)}, 2, '0') || '/' || lpad({g(2)}, 2, '0') || '/' || {g(3)} END"


def agency_sql(text: str) -> str:
    named = ", ".join(f"CASE WHEN contains(upper(left({text}, {AGENCY_HEAD})), '{k}') THEN '{v}' END" for k, v in AGENCIES)
    return f"CASE WHEN {text} IS NOT NULL THEN coalesce(list_filter([{named}], lambda a: a IS NOT NULL)[1], '') END"


def issue_date_sql(text: str) -> str:
    return f"CASE WHEN {text} IS NOT NULL THEN coalesce({_day_sql(f'left({text}, {ISSUE_HEAD})', ISSUED)}, {_day_sql(text, ADOPTED)}, '') END"


def effective_date_sql(text: str) -> str:
    heading = _re2("(?m)" + FINAL_ARTICLE)
    heads, gaps = f"regexp_extract_all({text}, {heading})", f"regexp_split_to_array({text}, {heading})"
    size = lambda parts: f"list_sum(list_transform(list_slice({parts}, 1, i), lambda x: length(x)))"
    scopes = f"list_transform(range(1, len({heads}) + 1), lambda i: substr({text}, CAST({size(heads)} + {size(gaps)} AS BIGINT) + 1, {FINAL_WINDOW}))"
    first = lambda scope: "coalesce(" + ", ".join(_day_sql(scope, p) for p in IN_FORCE) + ")"
    named = f"list_filter(list_transform({scopes}, lambda s: {first('s')}), lambda d: d IS NOT NULL)[1]"
    return f"CASE WHEN {text} IS NOT NULL THEN coalesce({named}, {first(text)}, CASE WHEN regexp_matches({text}, {_re2(FROM_SIGNING)}) THEN {issue_date_sql(text)} END, '') END"


# titles

#: Lines of a head that are no title, what ends a title, how far and how many lines are read.
NO_TITLE = ("QUỐC HỘI", "CỘNG HÒA", "ĐỘC LẬP", "HÀ NỘI")
TITLE_ENDS = ("PHẦN", "CHƯƠNG", "MỤC", "ĐIỀU", "CĂN CỨ", "THEO ĐỀ NGHỊ", "QUYẾT ĐỊNH:", "BỘ TRƯỞNG")
TITLE_HEAD, TITLE_LINES = 3000, 4
_LINE_END = r"\r\n|[\n\r\x{B}\x{C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def title(text: Column) -> Column:
    """The type's name and the lines below the first line that names a type, up to the first structural one."""
    names = [name for name, _ in T.TYPES]
    is_type = lambda l: F.upper(l).isin(*names)
    noise = lambda l: reduce(or_, (F.contains(F.upper(l), F.lit(n)) for n in NO_TITLE))
    ends = lambda l: reduce(or_, (F.startswith(F.upper(l), F.lit(n)) for n in TITLE_ENDS)) & ~is_type(l)
    lines = F.filter(F.transform(F.split(F.left(text, F.lit(TITLE_HEAD)), _LINE_END), lambda l: T.apply(l, T.STRIP)), lambda l: (l != "") & ~noise(l))
    below = lambda every: F.slice(every, F.array_position(F.transform(every, is_type), F.lit(True)).cast("int") + 1, TITLE_HEAD)
    upto = lambda tail: F.when(F.exists(tail, ends), F.slice(tail, F.lit(1), F.array_position(F.transform(tail, ends), F.lit(True)).cast("int") - 1)).otherwise(tail)
    parts = lambda tail: F.slice(F.filter(upto(tail), lambda l: ~is_type(l) & ~l.rlike(r"^[-\s]+$")), 1, TITLE_LINES)
    found = lambda every: F.when(F.exists(every, is_type), _let(below(every), lambda tail: F.array_join(parts(tail), " "))).otherwise("")
    kinds = F.create_map(*(F.lit(x) for name, code in T.TYPES for x in (code, name)))
    return F.when(text.isNotNull(), F.trim(F.concat_ws(" ", F.nullif(F.coalesce(kinds[T.document_type(text)], F.lit("")), F.lit("")), _let(lines, found))))


def title_sql(text: str) -> str:
    names = ", ".join(f"'{n}'" for n, _ in T.TYPES)
    noise = " OR ".join(f"contains(upper(l), '{n}')" for n in NO_TITLE)
    ends = "(" + " OR ".join(f"starts_with(upper(l), '{n}')" for n in TITLE_ENDS) + f") AND upper(l) NOT IN ({names})"
    lines = f"list_filter(list_transform(regexp_split_to_array(left({text}, {TITLE_HEAD}), '{_LINE_END}'), lambda l: {T.apply_sql('l', T.STRIP)}), lambda l: l <> '' AND NOT ({noise}))"
    tail = f"list_slice(v, list_position(list_transform(v, lambda l: upper(l) IN ({names})), true) + 1, {TITLE_HEAD})"
    cut = f"CASE WHEN len(list_filter(w, lambda l: {ends})) > 0 THEN list_slice(w, 1, list_position(list_transform(w, lambda l: {ends}), true) - 1) ELSE w END"
    parts = f"list_slice(list_filter({cut}, lambda l: upper(l) NOT IN ({names}) AND NOT regexp_full_match(l, '[-\\s]+')), 1, {TITLE_LINES})"
    found = f"list_transform([{lines}], lambda v: CASE WHEN len(list_filter(v, lambda l: upper(l) IN ({names}))) > 0 THEN list_transform([{tail}], lambda w: array_to_string({parts}, ' '))[1] ELSE '' END)[1]"
    kind = f"CASE {T.document_type_sql(text)} " + " ".join(f"WHEN '{code}' THEN '{name} '" for name, code in T.TYPES) + " ELSE '' END"
    return f"CASE WHEN {text} IS NOT NULL THEN trim({kind} || {found}) END"
