"""Typed, null-last sort keys: letter grades, ranges, numbers with units, natural text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.numbers import let
from rowloom.functions.text import collapse_space, nfkc

#: Letter grades from best to worst; the worst has value 1 (fixed values).
GRADES = ("SS", "S+", "S", "A+", "A", "B+", "B", "C+", "C", "D+", "D", "E+", "E", "F", "G")
#: Texts that count as empty when sorting (fixed values).
BLANKS = ("", "—", "–", "-", "無", "不明")
#: Rank of a row's status, and units behind a number (fixed values).
STATUS = {"確認": 3, "推定": 2, "候選": 1, "待辨識": 0}
UNITS = "歳|歲|km/h|km|球|人"


def is_blank(value: Column) -> Column:
    return value.isNull() | F.trim(value).isin(*BLANKS)


def grade_value(text: Column) -> Column:
    """15 for the best letter grade down to 1; null for other texts."""
    upper = F.upper(F.trim(text))
    return F.coalesce(*[F.when(upper == g, len(GRADES) - i) for i, g in enumerate(GRADES)]).cast("double")


def natural_text(text: Column) -> Column:
    """Lower case with the number of its digits before every number, so that item2 comes before item10, however long numbers are."""

    def numbered(digits: Column) -> Column:
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|[^\d]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), numbered(F.regexp_replace(p, "^0+(?=.)", ""))).otherwise(p)), "")


def sort_key(value: Column, speed: bool = False, status: bool = False) -> Column:
    """Struct of blank, number and text: blanks last in either direction, then numbers, then natural text.

    Of a range with slashes the last part may be a grade (or, with ``speed``, a number). Numbers
    come before texts; that order is fixed here, as comparing them as text would be no order.
    """
    blank = is_blank(value.cast("string"))

    def keyed(text: Column) -> Column:
        last = F.trim(F.element_at(F.split(text, "/"), -1))
        whole = F.when(text.rlike(rf"(?i)^\d+(\.\d+)?({UNITS})?$"), F.regexp_extract(text, r"^\d+(\.\d+)?", 0).cast("double"))
        number = F.coalesce(grade_value(last), whole)
        if speed:
            number = F.coalesce(number, F.when(last.rlike(r"^\d+(\.\d+)?$"), last.cast("double")))
        if status:
            number = F.coalesce(*[F.when(text == k, float(v)) for k, v in STATUS.items()], F.lit(-1.0))
        return let(number, lambda n: F.struct(blank.alias("blank"), F.when(~blank, n).alias("number"), F.when(~blank & n.isNull(), natural_text(text)).alias("text")))

    # the normalised text is bound once; a plain reference would be computed at each of its uses
    return let(collapse_space(nfkc(value.cast("string"))), keyed)


def ordering(key: str, ordinal: str, descending: bool = True) -> list[Column]:
    """Sort columns for a sort_key() column: blanks last both ways, ties by the ordinal."""
    if descending:
        return [F.col(f"{key}.blank"), F.col(f"{key}.text").desc_nulls_last(), F.col(f"{key}.number").desc_nulls_last(), F.col(ordinal)]
    return [F.col(f"{key}.blank"), F.col(f"{key}.number").asc_nulls_last(), F.col(f"{key}.text").asc_nulls_first(), F.col(ordinal)]


#: Case, accents and the kind of kana don't count.
COLLATION = "ja_CI_AI"


def collated_key(value: Column) -> Column:
    """sort_key() whose text compares by COLLATION: a total order of keys, blanks last, numbers before texts."""
    return let(sort_key(value), lambda key: F.struct(key["blank"].alias("blank"), key["number"].alias("number"), F.collate(key["text"], COLLATION).alias("text")))


def collated_ordering(key: str) -> list[Column]:
    """Ascending sort columns for a collated_key() column."""
    return [F.col(f"{key}.blank"), F.col(f"{key}.number").asc_nulls_last(), F.col(f"{key}.text").asc_nulls_first()]


def ability_pair(value: Column) -> Column:
    """Limit, then growth, of a growth/limit pair of grades, as sort values."""
    return let(F.split(nfkc(value), "/"), lambda parts: F.struct(grade_value(F.element_at(parts, -1)).alias("limit"), grade_value(F.get(parts, 0)).alias("growth")))


def default_descending(column: str, alphabetic: set[str]) -> bool:
    return column not in alphabetic
