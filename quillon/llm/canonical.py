"""One consistent form for texts that print alike.

Each Arrow partition is handed to an embedded DuckDB, whose SQL does all the work:
``translate`` maps full-width and look-alike characters, regular expressions remove
what prints nothing and squeeze white space, ``nfc_normalize`` composes accents.

Two texts have the same canonical form if they show the same letters with the same
accents, the same digits and the same punctuation, whatever their width, composition
or script.  Letter case, the vowel that carries the tone, d and đ, dash and hyphen stay
different.

Look-alike letters are those of the public confusables data, read from the ICU library
that Spark brings along, by rule: a cased letter of another script whose skeleton is
that of a Latin letter of the same case.

Defined results: a null text has a null form, an empty or blank one the empty form.
Rows are independent.  Extra columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from quillon.session import Scratch

#: Letters of other scripts and the Latin letters that they look like, in pairs; they hold before the confusables data.
LOOK_ALIKES = (
    # Cyrillic capitals, small letters
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԚQ ԜW ѴV "
    "аa еe ѕs іi јj оo рp сc уy хx үy һh ԛq ԝw ԁd ӏl ѵv "
    # Greek capitals, small letters
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϺM "
    "οo ϲc ϳj νv "
    # Latin and Armenian letters
    "ÐĐ ƉĐ ɡg ɑa օo ոn սu հh ցg"
)
#: Signs that print as others.
SIGNS = (("‐‑﹣", "-"), ("·‧⋅・･", "·"), ("․﹒", "."), ("꞉ː∶﹕", ":"), (";﹔", ";"), ("⁄∕", "/"), ("‚﹐", ","), ("∣", "|"))
#: Roman numerals and other forms that print as several characters.
SPELLED = {"Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅴ": "V", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅹ": "X", "Ⅺ": "XI", "Ⅻ": "XII", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M"}
SPELLED |= {chr(ord(k) + 16): v.lower() for k, v in SPELLED.items()}
SPELLED |= {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "…": "...", "‥": "..", "ǉ": "lj", "ǌ": "nj", "ǳ": "dz", "Ĳ": "IJ", "ĳ": "ij", "‼": "!!", "⁇": "??", "⁈": "?!", "⁉": "!?", "℃": "°C", "℉": "°F"}
#: Class of characters that print nothing, and of white space.
INVISIBLE = r"[\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]"
BLANKS = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


_CONFUSABLE: dict[str, str] = {}


def confusables(spark: SparkSession) -> dict[str, str]:
    """Cased letters of other scripts and the Latin letters with their skeleton; about 200 letters, looked up once."""
    if not _CONFUSABLE:
        icu = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker
        checker = icu.Builder().build()
        skeletons = lambda letters: checker.getSkeleton("\n".join(letters)).split("\n")
        latin = [c for c in map(chr, range(128)) if c.isalpha()]
        shown = {(s, c.isupper()): c for s, c in zip(skeletons(latin), latin)}
        others = [c for c in map(chr, [*range(0x370, 0xD800), *range(0xE000, 0x1D400)]) if unicodedata.category(c) in ("Lu", "Ll") and unicodedata.normalize("NFKD", c) == c and not unicodedata.name(c, "LATIN").startswith("LATIN")]
        _CONFUSABLE.update({c: shown[s, c.isupper()] for s, c in zip(skeletons(others), others) if (s, c.isupper()) in shown})
    return _CONFUSABLE


def _tables(more: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """Characters that are replaced by one other, and by several: the compatibility blocks by rule, look-alikes with their composed forms, signs."""
    one: dict[str, str] = {}
    many = dict(SPELLED)
    for block in (range(0xFF01, 0xFFEF), range(0x1D400, 0x1D800), range(0x2F00, 0x2FD6), range(0xF900, 0xFB00), range(0x2F800, 0x2FA1E), range(0xFE30, 0xFE50)):
        for c in map(chr, block):
            to = unicodedata.normalize("NFKC", c)
            if len(to) == 1 and to != c and not to.isspace():
                one[c] = to
    one |= more | {pair[0]: pair[1] for pair in LOOK_ALIKES.split()}
    one |= {c: sign for characters, sign in SIGNS for c in characters if c != sign}
    for c in map(chr, [*range(0x370, 0x590), *range(0x1F00, 0x2000)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in one and c not in one:
            to = unicodedata.normalize("NFC", one[parts[0]] + parts[1:])
            (one if len(to) == 1 else many)[c] = to
    return {c: one.get(to, to) for c, to in one.items()}, many


def _plain() -> str:
    """Pattern of texts that need no mapping: printable ASCII and the composed letters of Vietnamese."""
    marks = ["", *"\u0300\u0301\u0303\u0309\u0323"]
    letters = {unicodedata.normalize("NFC", v + m) for v in "aăâeêioôơuưyAĂÂEÊIOÔƠUƯY" for m in marks} | set("đĐ")
    return "[ -~" + "".join(sorted(x for x in letters if len(x) == 1 and x > "~")) + "]*"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(column: str, more: dict[str, str]) -> str:
    """The SQL expression of the canonical form; ``more`` are look-alike letters beside the fixed ones."""
    one, many = _tables(more)
    source, target = "".join(sorted(one)), "".join(one[c] for c in sorted(one))
    expr = f"nfc_normalize(regexp_replace({column}, {_quote(INVISIBLE)}, '', 'g'))"
    expr = f"translate({expr}, {_quote(source)}, {_quote(target)})"
    rare = f"regexp_matches({column}, {_quote('[' + ''.join(sorted(many)) + ']')})"
    spelled = "y"
    for c, to in many.items():
        spelled = f"replace({spelled}, {_quote(c)}, {_quote(to)})"
    expr = f"CASE WHEN {rare} THEN list_transform([{expr}], lambda y: {spelled})[1] ELSE {expr} END"
    whole = f"trim(regexp_replace(nfc_normalize({expr}), {_quote(BLANKS)}, ' ', 'g'))"
    # texts of composed Latin letters, plain signs and single blanks alone are their own form
    return f"CASE WHEN NOT contains({column}, '  ') AND regexp_full_match({column}, {_quote(_plain())}) THEN trim({column}) ELSE {whole} END"


def _run_sql(con, sql: str, table: pa.Table) -> pa.Table:
    con.register("batch", table)
    try:
        return con.sql(sql).to_arrow_table()
    finally:
        con.unregister("batch")


def _mapper(select: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        try:
            con.execute("SET preserve_insertion_order = true")
            for b in batches:
                if b.num_rows:
                    got = _run_sql(con, f"SELECT {select}", pa.Table.from_batches([b]))
                    yield from got.rename_columns(names).combine_chunks().to_batches()
        finally:
            con.close()

    return run


def canonical_column(df: DataFrame, key: str, text: str, out: str = "canonical") -> DataFrame:
    """``(key, out)``: the canonical form of every row's text."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = StructType([StructField(key, df.schema[key].dataType), StructField(out, StringType())])
    return rows.mapInArrow(_mapper(f"k, {canonical_sql('t', confusables(df.sparkSession))} FROM batch", [key, out]), schema)


def canonical_digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, form, stored)``: digests of the canonical form and of the text as stored; blank texts have no row."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null and t <> ''")
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("form", BinaryType()), StructField("stored", BinaryType())])
    select = f"k, unhex(md5(c)) AS form, unhex(md5(t)) AS stored FROM (SELECT k, t, {canonical_sql('t', confusables(df.sparkSession))} AS c FROM batch) WHERE c <> ''"
    return rows.mapInArrow(_mapper(select, [key, "form", "stored"]), schema)


def alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(form, stored, first_key, copies)``: the stored texts of each canonical form that has more than one; a form of any number of rows is aggregated before it is shuffled."""
    classes = canonical_digests(df, key, text).groupBy("form", "stored").agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("copies"))
    several = classes.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form")
    return classes.join(several, "form", "left_semi")


def alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key_a, key_b)``: rows whose texts differ as stored but have one canonical form, the smaller key first.

    Whether a form has several stored texts is decided by aggregates (least and greatest
    digest) that are formed before the shuffle; only rows of such forms go on.  What is
    joined are the stored texts of a form, each once; a pair of those is then expanded
    to its rows, so the work is that of the pairs that come out, however many rows are
    stored alike.  The rows of a hot text are spread by the adaptive skew join.  The pairs
    are the result asked for; for a compact one take :func:`alike_classes`.
    """
    scratch = Scratch(df.sparkSession, "canonical")
    digests = scratch.save(canonical_digests(df, key, text).withColumnRenamed(key, "k"), "digests")
    mixed = digests.groupBy("form").agg(F.min("stored").alias("low"), F.max("stored").alias("high")).where("low <> high").select("form")
    rows = scratch.save(digests.join(mixed, "form", "left_semi"), "rows")
    classes = rows.select("form", "stored").distinct()
    other = classes.select(F.col("form").alias("o_form"), F.col("stored").alias("b"))
    pairs = classes.join(other, (F.col("form") == F.col("o_form")) & (F.col("stored") < F.col("b"))).select(F.col("stored").alias("a"), "b")
    first = pairs.join(rows.select(F.col("stored").alias("a"), F.col("k").alias("k_a")), "a").select("b", "k_a")
    both = first.join(rows.select(F.col("stored").alias("b"), F.col("k").alias("k_b")), "b")
    return both.select(F.least("k_a", "k_b").alias("key_a"), F.greatest("k_a", "k_b").alias("key_b"))
