"""A nested document corpus: exactly-once routing, flattening, row search and section filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.text import any_form, nfkc, python_key, query_forms, search_key


class RoutingError(ValueError):
    """The routes don't send every section to exactly one place."""


def route(sections: DataFrame, routes: DataFrame, overrides: DataFrame, archived: DataFrame) -> DataFrame:
    """Every section with its place: an override by (chapter_id, section) first, then the archive, then the chapter's route.

    routes: chapter_id, place; overrides: chapter_id, section, place; archived: chapter_id. The
    three have a row per chapter or exception. Sections gain ``place`` (null if nothing sends
    them), ``reading_id`` and ``original_chapter``.
    """
    o = overrides.select(F.col("chapter_id").alias("_oc"), F.col("section").alias("_os"), F.col("place").alias("_op"))
    a = archived.select(F.col("chapter_id").alias("_ac")).distinct().withColumn("_ap", F.lit("archive"))
    r = routes.select(F.col("chapter_id").alias("_rc"), F.col("place").alias("_rp"))
    out = sections.join(o, (F.col("chapter_id") == F.col("_oc")) & (F.col("section") == F.col("_os")), "left")
    out = out.join(a, F.col("chapter_id") == F.col("_ac"), "left").join(r, F.col("chapter_id") == F.col("_rc"), "left")
    out = out.withColumns({"place": F.coalesce("_op", "_ap", "_rp"), "reading_id": F.concat_ws(":", "chapter_id", "section"), "original_chapter": F.col("chapter_id")})
    return out.drop("_oc", "_os", "_op", "_ac", "_ap", "_rc", "_rp")


def check_routing(sections: DataFrame, routed: DataFrame) -> DataFrame:
    """Counts of what must be nothing: lost, doubled and unplaced sections. One row."""
    before = sections.select(F.concat_ws(":", "chapter_id", "section").alias("reading_id"))
    lost = before.exceptAll(routed.select("reading_id")).agg(F.count("*").alias("lost"))
    doubled = routed.groupBy("reading_id").count().agg(F.count_if(F.col("count") > 1).alias("doubled"))
    unplaced = routed.agg(F.count_if(F.col("place").isNull()).alias("unplaced"))
    return lost.join(doubled, F.lit(True)).join(unplaced, F.lit(True))


def check_routes(routes: DataFrame, routed: DataFrame, places: DataFrame, archive: str = "archive") -> DataFrame:
    """Counts of what must be nothing besides check_routing(): chapters with two routes, sections sent to a place that isn't there, places without an entry. One row.

    routes: chapter_id, place; places: place, each that a reader is shown; routed: place and ``entries``.
    """
    doubled = routes.groupBy("chapter_id").count().agg(F.count_if(F.col("count") > 1).alias("double_routes"))
    known = places.select(F.col("place").alias("_p")).distinct()
    sent = routed.filter(F.col("place").isNotNull() & (F.col("place") != archive)).groupBy("place").agg(F.count("*").alias("n"), F.sum("entries").alias("entries"))
    both = sent.join(known, F.col("place") == F.col("_p"), "full")
    off = F.when(F.col("_p").isNull(), F.col("n")).otherwise(0)
    rest = both.agg(F.coalesce(F.sum(off), F.lit(0)).alias("bad_places"), F.count_if(F.col("_p").isNotNull() & (F.coalesce("entries", F.lit(0)) == 0)).alias("empty_places"))
    return doubled.join(rest, F.lit(True))


def require_routing(sections: DataFrame, routed: DataFrame, routes: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """``routed``, or RoutingError where check_routing() finds anything, or check_routes() where routes and places are given."""
    found = check_routing(sections, routed).first().asDict()
    if routes is not None and places is not None:
        found |= check_routes(routes, routed, places).first().asDict()
    if any(found.values()):
        raise RoutingError(", ".join(f"{k}: {v}" for k, v in found.items() if v))
    return routed


def entry_count(rows: Column, items: Column) -> Column:
    """Rows and items of a section, missing arrays as none."""
    return F.coalesce(F.size(rows), F.lit(0)) + F.coalesce(F.size(items), F.lit(0))


def flatten(sections: DataFrame) -> DataFrame:
    """A row for each entry of each section: its rows (cells joined by a bar) or, only where it has none, its items.

    sections: chapter, section, title, ``rows`` (arrays of cells) and ``items``.
    """
    has_rows = F.coalesce(F.size("rows"), F.lit(0)) > 0
    lines = F.when(has_rows, F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "｜"))).otherwise(F.col("items"))
    return sections.select("chapter", "section", "title", F.when(has_rows, "row").otherwise("item").alias("kind"), F.posexplode(lines).alias("entry", "text"))


def search_rows(entries: DataFrame, query: str, synonyms: list[tuple[str, str]], first: list[str], excluded: str | None = None, order: tuple[str, ...] = ("chapter", "section", "entry")) -> DataFrame:
    """Hits of any form of the query in an entry or its section's title, once each, in order of priority.

    Sections whose title is in ``first`` come first, in that order. Of equal entries of one
    chapter and title the first stays; titles equal to ``excluded`` are dropped after that.
    """
    forms = query_forms(query, synonyms)
    hits = entries.filter(any_form(search_key(F.col("text")), forms) | any_form(search_key(F.col("title")), forms))
    rank = F.coalesce(*[F.when(F.col("title") == t, i) for i, t in enumerate(first)], F.lit(len(first)))
    # a minimum combines before the shuffle, so a line that stands everywhere costs no single task
    others = [c for c in entries.columns if c not in ("chapter", "title", "kind", "text", *order)]
    first_of = F.min(F.struct("priority", *order, *others)).alias("_first")
    kept = hits.withColumn("priority", rank).groupBy("chapter", "title", "kind", "text").agg(first_of)
    kept = kept.select(*[F.col(f"_first.{c}").alias(c) if c in (*order, *others) else F.col(c) for c in entries.columns], "_first.priority")
    return kept.filter(F.col("title") != excluded) if excluded else kept


def filter_sections(sections: DataFrame, query: str) -> DataFrame:
    """Sections with the items and rows that hold the query; all of them where the title does; empty sections go."""
    q = python_key(query)
    if not q:
        return sections
    titled = F.contains(search_key(F.col("title")), F.lit(q))
    kept = {"items": F.when(titled, F.col("items")).otherwise(F.filter("items", lambda i: F.contains(search_key(i), F.lit(q))))}
    if "rows" in sections.columns:
        kept["rows"] = F.when(titled, F.col("rows")).otherwise(F.filter("rows", lambda r: F.contains(search_key(F.array_join(r, " ")), F.lit(q))))
    size = sum((F.coalesce(F.size(c), F.lit(0)) for c in kept), F.lit(0))
    return sections.withColumns(kept).filter(size > 0)


def repeated_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Keys of rows that stand more than once, normalised and white space collapsed, as JSON, with their number."""
    clean = F.to_json(F.array(*[F.trim(F.regexp_replace(nfkc(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"(?U)\s+", " ")) for c in columns]))
    return rows.select(clean.alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows only one of two tables has, repeats counted. One row."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_a"))
    return left.join(b.exceptAll(a).agg(F.count("*").alias("only_b")), F.lit(True))
