"""Sources and gates: HTML tables and links, archives, JSON, fallback chains, fail-closed publishing."""

from __future__ import annotations

import io
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.functions.sortkeys import natural_text
from rowloom.functions.text import is_image

#: Limits of an archive: its size, an entry's size and the sum of its entries, in MB (fixed values).
ARCHIVE_MB, ENTRY_MB, EXPANDED_MB = 90, 18, 190


class GateError(ValueError):
    """A table that failed its checks; nothing was written."""


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """List entries that are links, by regular expressions alone: the page's columns but html, item, href, label."""
    pattern = r"<li>\s*<a\s+href=\"([^\"]*)\"[^>]*>([^<]*)</a>"
    hrefs, labels = (F.regexp_extract_all(html, F.lit(pattern), F.lit(i)) for i in (1, 2))
    found = pages.withColumn("_l", F.arrays_zip(hrefs.alias("href"), labels.alias("label")))
    kept = [c for c in pages.columns if c != html]
    return found.select(*kept, F.posexplode("_l").alias("item", "link")).select(*kept, "item", F.col("link.href").alias("href"), F.col("link.label").alias("label"))


class _Tables(HTMLParser):
    """Cells of every table of a page, by row; entities decoded, white space collapsed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def widest_table(html: str, required: str) -> list[dict[str, str]]:
    """Records of the table with the widest header that has ``required``; the first of equals; rows without that cell go."""
    parser = _Tables()
    parser.feed(html or "")
    best = None
    for rows in parser.tables:
        if rows and required in rows[0] and (best is None or len(rows[0]) > len(best[0])):
            best = rows
    if best is None:
        return []
    records = ({h: row[i] if i < len(row) else "" for i, h in enumerate(best[0])} for row in best[1:] if row)
    return [r for r in records if r.get(required)]


def table_rows(pages: DataFrame, required: str, html: str = "html", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row for each record of each page's table: the keys, its place and a map of its cells."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*[row[k] for k in keys], i, cells) for row in pdf.to_dict("records") for i, cells in enumerate(widest_table(row[html], required))]
            yield pd.DataFrame(out, columns=[*keys, "place", "cells"])

    schema = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, html).mapInPandas(parsed, f"{schema}, place int, cells map<string,string>")


def union_sources(parts: dict[str, DataFrame], tag: str = "_slug") -> DataFrame:
    """All sources in the order given, columns that only some have as null, with tag and an ordinal of the source."""
    out = None
    for i, (name, part) in enumerate(parts.items()):
        one = part.withColumns({tag: F.lit(name), "_source_no": F.lit(i)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def audit(records: DataFrame, name: Column, source: Column) -> DataFrame:
    """One row: rows, rows without name, rows without source, distinct sources."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return records.agg(F.count("*").alias("n_rows"), F.count_if(blank(name)).alias("unnamed"), F.count_if(blank(source)).alias("unsourced"), F.count_distinct(source).alias("sources"))


def require(records: DataFrame, name: str, source: str, rows: int, per_source: dict[str, int]) -> DataFrame:
    """``records``, or GateError where totals, names or any source's count are off."""
    counts = {r[source]: r["count"] for r in records.groupBy(source).count().collect()}
    wrong = {s: (counts.get(s, 0), n) for s, n in per_source.items() if counts.get(s, 0) != n} | {s: (n, 0) for s, n in counts.items() if s not in per_source}
    found = audit(records, F.col(name), F.col(source)).first()
    if wrong or found["n_rows"] != rows or found["unnamed"] or found["unsourced"]:
        raise GateError(f"{found['n_rows']} rows of {rows}, {found['unnamed']} unnamed, {found['unsourced']} unsourced, sources off: {wrong}")
    return records


def publish(records: DataFrame, path: str, gate: Callable[[DataFrame], DataFrame], meta: DataFrame | None = None) -> DataFrame:
    """Write a new version below ``path``, check what was written, and only then point to it; read_published() reads it.

    A failure at any time, GateError too, leaves the version before as it was: its files are not
    touched, and the pointer is one row appended at the end. Versions before it stay.
    """
    spark, version = records.sparkSession, uuid.uuid4().hex
    records.write.parquet(f"{path}/version-{version}")
    gate(spark.read.parquet(f"{path}/version-{version}"))
    if meta is not None:
        meta.write.parquet(f"{path}/meta-{version}")
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{path}/current")
    return spark.read.parquet(f"{path}/version-{version}")


def read_published(spark: SparkSession, path: str, part: str = "version") -> DataFrame:
    """What publish() last pointed to; part ``meta``: its meta table."""
    version = spark.read.parquet(f"{path}/current").agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(f"{path}/{part}-{version}")


def refresh(spark: SparkSession, fetch: Callable[[int], DataFrame], path: str, gate: Callable[[DataFrame], DataFrame], attempts: int = 2, pause: float = 0.5) -> tuple[DataFrame, str]:
    """The newest published table and what became of the update: up to ``attempts`` tries of fetch(attempt) and publish(), ``pause`` seconds apart.

    After the last failure the table published before stays and is returned, and the message says why and how many rows are kept.
    Without any published table the failure is raised.
    """
    failure: Exception | None = None
    for attempt in range(attempts):
        try:
            done = publish(fetch(attempt), path, gate)
            return done, f"updated: {done.count()} rows"
        except (GateError, PySparkException, OSError) as e:
            failure = e
            if attempt + 1 < attempts:
                time.sleep(pause)
    try:
        kept = read_published(spark, path)
    except AnalysisException:
        raise failure from None
    return kept, f"update failed: {str(failure).splitlines()[0]}; {kept.count()} rows kept"


def first_valid(spark: SparkSession, paths: list[tuple[str, str]], gate: Callable[[DataFrame], DataFrame], fallback: DataFrame) -> DataFrame:
    """The first of (label, path) whose table passes the gate, else the fallback; ``_provenance`` says which."""
    for label, path in paths:
        try:
            return gate(spark.read.parquet(path)).withColumn("_provenance", F.lit(label))
        except (GateError, AnalysisException):
            continue
    return fallback.withColumn("_provenance", F.lit("fallback sample"))


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON document or array with an explicit schema; malformed input raises."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files below a folder, each once by path, length and time; ``name`` is the flattened relative path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.filter(is_image(F.col("path"))).dropDuplicates(["path", "length", "modificationTime"])
    base = path.rstrip("/").removeprefix("file://")
    return found.withColumn("name", F.regexp_replace(F.split_part("path", F.lit(f"{base}/"), F.lit(-1)), "/", "__"))


def archive_entries(archives: DataFrame) -> DataFrame:
    """Image entries of ZIP archives (``path``, ``content``) in natural order: path, archive, name, content, place, error.

    An archive that is broken or passes a limit gives one row with its ``error`` and nothing else,
    and stops none of the others. Archives are told apart by their path.
    """

    def entries(archive: str, content: bytes) -> list[tuple[str, bytes]]:
        mb, out, total = 1 << 20, [], 0
        if len(content) > ARCHIVE_MB * mb:
            raise GateError(f"over {ARCHIVE_MB} MB")
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                last = info.filename.rsplit("/", 1)[-1]
                if info.is_dir() or info.filename.startswith("__MACOSX/") or last.startswith("._") or last == ".DS_Store" or not last.lower().endswith((".png", ".jpg", ".jpeg", ".webp", ".bmp")):
                    continue
                total += info.file_size
                if info.file_size > ENTRY_MB * mb or total > EXPANDED_MB * mb:
                    raise GateError(f"{info.filename} passes a limit")
                out.append((f"{archive}__{info.filename.replace('/', '__')}", z.read(info)))
        return out

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                archive = path.rsplit("/", 1)[-1].removesuffix(".zip")
                try:
                    rows = [(path, archive, name, body, None) for name, body in entries(archive, content)]
                except (GateError, zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, TypeError) as e:
                    rows = [(path, archive, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "archive", "name", "content", "error"])

    found = archives.select("path", "content").mapInPandas(opened, "path string, archive string, name string, content binary, error string")
    order = Window.partitionBy("path").orderBy(natural_text(F.col("name")), "name")
    return found.withColumn("place", F.when(F.col("error").isNull(), F.row_number().over(order)))


def dedup_events(rows: DataFrame, identity: list[str], order: str) -> DataFrame:
    """The first row of each identity by ``order``, by an aggregate that combines before the shuffle."""
    others = [c for c in rows.columns if c not in identity]
    best = F.min_by(F.struct(*others), F.col(order)).alias("_first")
    return rows.groupBy(*identity).agg(best).select(*identity, "_first.*").select(*rows.columns)
