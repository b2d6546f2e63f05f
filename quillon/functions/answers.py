"""The letter that a model chose in its answer, in the four ways in which drivers read it, and the text of a question.

Defined results: a null answer counts as empty; an answer without a letter gives ``N/A``,
or, where a way falls back to the first sign, that sign.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as T

#: What stands for no letter; where a letter is looked for, in the order of the tagged way; how far the ways look; and the form of a question.
NOTHING = "N/A"
TAG = r"<output>\s*([A-D])"
ANNOUNCED = r"(?:đáp án|chọn|là|output|answer)\s*[:]?\s*([A-D])"
BRACKETED = r"[\(\[\*]+([A-D])[\)\]\*]+"
OWN_LINE = r"^[ \t]*([ABCD])[ \t]*$"
TAIL, HEAD = 50, 10
ASKED = "\nCâu hỏi: "


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _full(answer: Column) -> Column:
    return F.coalesce(answer, F.lit(""))


def strict(answer: Column) -> Column:
    """The first letter A to D that stands alone, in any case; else the first sign if it is one."""
    upper = F.upper(_full(answer))
    return F.coalesce(_group(upper, rf"{T.LEFT}([A-D]){T.RIGHT}"), _group(T.apply(upper, T.STRIP), r"^([A-D])"), F.lit(NOTHING))


def tagged(answer: Column) -> Column:
    """After the output tag; else announced; else in brackets; else the whole answer; else the last one alone among the last 50 signs."""
    a = _full(answer)
    last = F.upper(F.right(a, F.lit(TAIL)))
    alone = F.try_element_at(F.filter(F.split(last, r"[^\p{L}\p{M}\p{N}_]+"), lambda w: w.isin("A", "B", "C", "D")), F.lit(-1))
    return F.coalesce(
        F.upper(_group(a, "(?iu)" + TAG)),
        F.upper(_group(a, f"(?iu){ANNOUNCED}{T.RIGHT}")),
        _group(a, BRACKETED),
        _group(F.upper(T.apply(a, T.STRIP)), r"^([A-D])$"),
        alone,
        F.lit(NOTHING),
    )


def line_first(answer: Column) -> Column:
    """A line that is the letter alone; else the first letter among the first ten signs; else the first sign."""
    a = _full(answer)
    return F.coalesce(_group(a, "(?md)" + OWN_LINE), _group(F.left(a, F.lit(HEAD)), "([ABCD])"), F.left(T.apply(a, T.STRIP), F.lit(1)))


WAYS = {"strict": strict, "tagged": tagged, "line_first": line_first}


def question_text(instruction: Column, question: Column, answers: Column) -> Column:
    """What is sent to a model for one question of a benchmark; missing parts are empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(part(instruction), F.lit(ASKED), part(question), F.lit("\n"), part(answers))
