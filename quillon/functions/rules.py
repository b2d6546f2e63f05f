"""Rules over names: kinds of folders, relations that follow from them, and composite name filters."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of folders in the order in which they are tried.
FOLDERS = ("luat", "nghi_dinh", "nghi_quyet", "thong_tu", "sua_doi_bo_sung", "thay_the", "bai_bo", "dinh_chi_hieu_luc")
#: The relation of a document of a kind to a law.
RELATION_OF = {
    "sua_doi_bo_sung": "sua_doi_bo_sung",
    "thay_the": "thay_the",
    "bai_bo": "bai_bo",
    "dinh_chi_hieu_luc": "dinh_chi_hieu_luc",
    "nghi_dinh": "huong_dan_thi_hanh",
    "nghi_quyet": "huong_dan_thi_hanh",
    "thong_tu": "huong_dan_thi_hanh",
}
#: Relations by the name that is shown.
SHOWN_RELATIONS = {"Thay thế": "thay_the", "Hướng dẫn thi hành": "huong_dan_thi_hanh", "Căn cứ": "can_cu"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def folder_kind(name: Column) -> Column:
    """The first kind that is part of the folder's name or of which the name is a part, else ``other``; null for null."""
    low = F.lower(F.trim(name))
    found = F.when(name.isNull(), F.lit(None).cast("string"))
    for kind in FOLDERS:
        found = found.when(F.contains(low, F.lit(kind)) | F.contains(F.lit(kind), low), kind)
    return found.otherwise("other")


def relation_between(source: Column, target: Column) -> Column:
    """The relation that follows from the kinds of two folders; none unless the target holds laws."""
    return F.when(target == "luat", F.try_element_at(_map(RELATION_OF), source))


def relation_code(shown: Column) -> Column:
    """The code of a relation's shown name; other texts stay."""
    return F.coalesce(F.try_element_at(_map(SHOWN_RELATIONS), shown), shown)


def name_filter(name: Column, exact: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), not_prefixes: tuple[str, ...] = (), not_parts: tuple[str, ...] = (), parts_unless: dict[str, tuple[str, ...]] | None = None, prefixes_unless: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Names that are listed or begin as listed, without those that begin or hold what is excluded.

    ``parts_unless`` excludes a part unless one of the given longer ones is there as
    well; ``prefixes_unless`` a beginning unless the whole name is one of those given.
    """
    kept = reduce(or_, [name.isin(*exact), *(F.startswith(name, F.lit(p)) for p in prefixes)])
    out = [~F.startswith(name, F.lit(p)) for p in not_prefixes] + [~F.contains(name, F.lit(p)) for p in not_parts]
    out += [~F.contains(name, F.lit(p)) | reduce(or_, (F.contains(name, F.lit(x)) for x in longer)) for p, longer in (parts_unless or {}).items()]
    out += [~F.startswith(name, F.lit(p)) | name.isin(*whole) for p, whole in (prefixes_unless or {}).items()]
    return reduce(and_, out, kept)
