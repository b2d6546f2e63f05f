"""Comparable keys of document numbers that are written in several ways."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The code points with the Unicode property White_Space, as a character class.
WHITE_SPACE = "\\u0009-\\u000D\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Composed form, computed by Arrow's own kernel over whole batches."""
    return pc.utf8_normalize(text, form="NFC")


@F.arrow_udf(StringType())
def _nfkd(text: pa.Array) -> pa.Array:
    return pc.utf8_normalize(text, form="NFKD")


def bare(text: Column) -> Column:
    """Without combining marks, compatibility forms spelled out; đ stays."""
    return F.regexp_replace(_nfkd(text), "[\u0300-\u036F\u1AB0-\u1AFF\u1DC0-\u1DFF\u20D0-\u20FF\uFE20-\uFE2F]", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and all-white text."""
    return F.coalesce(~text.rlike(f"[^{WHITE_SPACE}]"), F.lit(True))


def number_key(text: Column) -> Column:
    """Key under which spellings of one document number meet: composed, lower case, d for đ, one sign between parts, none around them."""
    plain = F.translate(F.lower(nfc(text)), "đ", "d")
    return F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{M}\p{N}]+", "_"), "^_|_$", "")
