"""Vector expressions over ``ARRAY<FLOAT>`` columns, all inside the JVM.

Arithmetic is done in DOUBLE.  A vector that is null, has a null in it or has no length
gives a null distance; a cosine with a zero vector is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def ip_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


METRICS = {"cosine": cosine_distance, "l2": l2_distance, "ip": ip_distance}


def resize(a: Column, size: int) -> Column:
    """Cut or padded with zeros to ``size`` numbers."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), size)), 1, size)


def normalize(a: Column, least: float = 1e-9) -> Column:
    """Scaled to length one; the length is taken as at least ``least``."""
    length = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / length)


def pool(tokens: Column, mask: Column, way: str = "auto", sentence: Column | None = None) -> Column:
    """One vector out of the vectors of a text's tokens (an array of arrays).

    ``cls`` takes the first token; ``mean`` the mean of the tokens whose mask is 1, the
    count taken as at least 1e-9; ``auto`` the model's own vector ``sentence`` where it
    gives one, else the first token; ``none`` that vector alone.  No token gives null.
    """
    if way not in ("cls", "mean", "auto", "none"):
        raise ValueError("pooling is cls, mean, auto or none")
    if way == "none":
        if sentence is None:
            raise ValueError("pooling none needs the model's own vector")
        return sentence
    first = F.when(F.size(tokens) > 0, F.element_at(tokens, 1))
    if way in ("cls", "auto"):
        return first if way == "cls" or sentence is None else F.coalesce(sentence, first)
    weighted = F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x.cast("double") * m))
    zero = F.transform(F.element_at(tokens, 1), lambda _: F.lit(0.0))
    summed = F.aggregate(weighted, zero, lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
    count = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    return F.when(F.size(tokens) > 0, F.transform(summed, lambda x: x / F.greatest(count, F.lit(1e-9))))
