"""Line dedup by overlapping three-line windows.

Each run of three consecutive lines is hashed. A window that stands more than once in the
corpus keeps its first place, in order of (doc_id, line); every later place covers its three
lines, covered positions are merged, and covered lines go. A removed line always has an equal
line at an earlier place, so no text disappears from the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import spread_join, staged


def dedup_lines(docs: DataFrame, window: int = 3) -> DataFrame:
    """``docs`` with the lines of later window occurrences removed from ``text``, plus ``n_lines`` and ``n_removed``.

    docs: ``doc_id`` and ``text``; other columns pass through, except ones named ``n_lines``
    or ``n_removed``, which are replaced. A null text counts as an empty one and stays null; a
    document of fewer than ``window`` lines has no window and stays whole. Windows of blank
    lines only are left alone. Rows that agree in doc_id and text count as one document and
    keep or lose the same lines; a null doc_id comes first. Empty input gives no rows.
    """
    held = docs.drop("n_lines", "n_removed").withColumns({"_rl_lines": F.split(F.coalesce("text", F.lit("")), "\n", -1), "_rl_text": F.xxhash64("text")})
    last = F.size("_rl_lines") - window
    joined = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("_rl_lines", i + 1, window), "\n").alias("body")))
    hashed = F.transform(
        F.filter(joined, lambda w: F.trim(F.translate(w["body"], "\n\r\t", "")) != ""),
        lambda w: F.struct(w["pos"].alias("pos"), F.xxhash64(w["body"]).alias("h"), F.hash(w["body"]).alias("g")),
    )
    windows = held.filter(last >= 0).select(F.col("doc_id").alias("_rl_doc"), F.col("_rl_text").alias("_rl_key"), F.inline(hashed))
    windows = staged(windows, "line-windows")
    place = F.struct("_rl_doc", "_rl_key", "pos")
    repeated = windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    later = spread_join(windows, repeated, ["h", "g"], "n", F.struct("_rl_doc", "pos")).filter(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("_rl_doc", "_rl_key").agg(F.collect_set("pos").alias("_rl_starts"))
    out = held.join(covered, F.col("doc_id").eqNullSafe(F.col("_rl_doc")) & (F.col("_rl_text") == F.col("_rl_key")), "left")
    marked = F.array_distinct(F.flatten(F.transform("_rl_starts", lambda s: F.sequence(s, s + window - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_rl_lines") - 1), marked)
    rest = F.array_join(F.transform(kept, lambda i: F.get("_rl_lines", i)), "\n")
    hit = F.col("_rl_starts").isNotNull()
    out = out.withColumns({"text": F.when(hit, rest).otherwise(F.col("text")), "n_lines": F.size("_rl_lines"), "n_removed": F.when(hit, F.size(marked)).otherwise(0)})
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


LINES_SQL = r"""
WITH l AS (SELECT doc_id, text IS NULL AS void, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
w AS (SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS body FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS place FROM w
      WHERE body IS NOT NULL AND trim(translate(body, chr(10) || chr(13) || chr(9), '')) <> ''),
c AS (SELECT DISTINCT doc_id, pos + i AS pos FROM k, (SELECT unnest([0, 1, 2]) AS i) WHERE place > 1)
SELECT l.doc_id, CASE WHEN any_value(void) THEN NULL ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') END AS text,
       CAST(count(*) AS INTEGER) AS n_lines, CAST(count(c.pos) AS INTEGER) AS n_removed
FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
"""
