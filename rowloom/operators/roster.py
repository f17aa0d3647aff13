"""Record search: facets, splits, paging, detail and comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.text import python_key


def search(records: DataFrame, key: str, query: str = "", facets: dict[str, object] | None = None) -> DataFrame:
    """Rows whose search key holds the query and that equal every non-empty facet."""
    tests = [F.contains(F.col(key), F.lit(q))] if (q := python_key(query)) else []
    tests += [F.col(c) == v for c, v in (facets or {}).items() if v not in ("", None)]
    return records.filter(reduce(lambda a, b: a & b, tests)) if tests else records


def page_of(records: DataFrame, group: list[Column], order: list[Column], size: int = 40) -> DataFrame:
    """``position`` and ``page`` of each row in its group, and the group's number of ``pages``.

    Rows are numbered by a window, so a group's rows meet in one task; use fetch_page() for one page.
    """
    inside = Window.partitionBy(*group)
    numbered = records.withColumn("position", F.row_number().over(inside.orderBy(*order)))
    return numbered.withColumns({"page": F.expr(f"(position - 1) div {size} + 1").cast("int"), "pages": F.ceil(F.count("*").over(inside) / size).cast("int")})


def fetch_page(records: DataFrame, group: list[str], order: list[Column], page: int = 1, size: int = 40) -> DataFrame:
    """One page of each group; a page beyond the last is the last, one below the first the first.

    Group sizes come from an aggregate; the rank limit is pushed below the shuffle, so tasks
    pass on no more than page * size rows of a group.
    """
    counts = records.groupBy(*group).agg(F.count("*").alias("_n"))
    top = records.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("position") <= page * size)
    joined = top.join(counts.select(*[F.col(g).alias(f"_{g}") for g in group], "_n"), reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]))
    last = F.ceil(F.col("_n") / size)
    shown = F.greatest(F.least(F.lit(page), last), F.lit(1))
    return joined.filter((F.col("position") > (shown - 1) * size) & (F.col("position") <= shown * size)).withColumns({"page": shown.cast("int"), "pages": last.cast("int")}).drop("_n", *[f"_{g}" for g in group])


def detail(records: DataFrame, id_column: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """A row for each non-empty attribute of each record: id, attribute, value; names with a leading underscore are left out."""
    shown = [c for c in records.columns if c != id_column and c not in skip and not c.startswith("_")]
    long = records.select(id_column, *[F.col(c).cast("string").alias(c) for c in shown]).unpivot(id_column, shown, "attribute", "value")
    return long.filter(F.col("value").isNotNull() & (F.col("value") != ""))


def toggle(chosen: list, item, known: set | None = None, most: int = 20) -> list:
    """A comparison set after a click: out if in, in if known and below ``most``."""
    if item in chosen:
        return [c for c in chosen if c != item]
    return chosen if len(chosen) >= most or (known is not None and item not in known) else [*chosen, item]


def compare(records: DataFrame, chosen: DataFrame, id_column: str, slots: int = 20) -> DataFrame:
    """Attributes as rows and chosen records as columns s1 to s``slots``.

    chosen: id and ``slot``, at most ``slots`` rows (a bounded side, so it is broadcast).
    Attributes without a value in any chosen record go; missing values show as —.
    """
    held = chosen.filter(F.col("slot") <= slots).limit(slots).select(F.col(id_column).alias("_id"), "slot")
    kept = records.join(F.broadcast(held), F.col(id_column) == F.col("_id")).drop("_id")
    shown = [c for c in kept.columns if c not in ("slot", id_column) and not c.startswith("_")]
    long = kept.select("slot", *[F.col(c).cast("string").alias(c) for c in shown]).unpivot("slot", shown, "attribute", "value")
    full = F.col("value").isNotNull() & ~F.col("value").isin("", "–")
    long = long.withColumn("_some", F.max(full).over(Window.partitionBy("attribute"))).filter("_some")
    wide = long.groupBy("attribute").pivot("slot", list(range(1, slots + 1))).agg(F.first("value"))
    return wide.select("attribute", *[F.coalesce(F.nullif(F.col(str(i)), F.lit("")), F.lit("—")).alias(f"s{i}") for i in range(1, slots + 1)])


def correct_names(records: DataFrame, fixes: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Names replaced where name and all keys match a fix (columns name, keys, ``new_name``); the old one stays as ``_name_orig``.

    Of several fixes for one name and keys the smallest new name counts, so that no record is doubled.
    """
    by = [name, *keys]
    side = fixes.groupBy(*[F.col(c).alias(f"_fix_{c}") for c in by]).agg(F.min("new_name").alias("new_name"))
    joined = records.join(side, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_fix_{c}") for c in by]), "left")
    changed = F.col("new_name").isNotNull()
    return joined.withColumns({"_name_orig": F.when(changed, F.col(name)), name: F.coalesce("new_name", name)}).drop("new_name", *[f"_fix_{c}" for c in by])


def counts(records: DataFrame, is_special: Column) -> DataFrame:
    """Total, special and other rows in one pass."""
    return records.agg(F.count("*").alias("total"), F.count_if(is_special).alias("special"), F.count_if(~is_special).alias("other"))
