"""Mixing sources to target weights with hash-random keys and distributed prefix sums.

Every document gets a hash-random key, which orders its source. The key space of a source is
cut into equal ranges; the words of each range are summed, the sums of the earlier ranges give
a range's offset, and a running sum inside each range completes the prefix sum. No task ever
holds more than one range of one source, however large the source is. A source's budget is
then cut exactly: whole epochs first, then documents in key order up to the last word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import staged, word_count

#: Weights that the sources take in turn, in code-point order.
WEIGHTS = (3, 1, 2)


def random_key(doc_id: Column, digest: Column, seed: str) -> Column:
    """The text's digest takes part, so that rows without a doc_id, or with the same one, spread as well."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(digest, F.lit("")), F.lit(":" + seed)))


def source_targets(sizes: DataFrame, share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): weights share ``share`` of all words, no source above ``epochs`` times its own.

    One task ranks the sources, one row each: their number has to be one that a task can sort.
    What a source at its limit leaves goes to the others by weight until none is above, which
    is filling to one level: sources in order of limit per weight reach their limit while it
    lies under the level that the rest would get.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("_w", cycle).withColumn("_cap", F.col("source_size") * epochs)
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(share)
    leveled = ranked.withColumn("_level", (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(after))
    level = F.max("_level").over(everything)  # it rises while sources reach their limit and falls after
    target = F.least(F.col("_cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("_w"))
    return leveled.withColumn("target", target).select("source", "source_size", "target")


def mix(docs: DataFrame, size: str | None = None, share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS, digits: int = 3, seed: str = "mix", digest: str | None = None) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``taken`` (words that the mix takes, repeats counted) to ``docs``.

    docs: ``doc_id``, ``source`` and either ``text`` or the columns named by ``size`` and
    ``digest`` (the text's md5); other columns pass through, but those with the names that are
    added here give way. A null text has no words, a null source is a source of its own and
    comes last, a null doc_id counts as the empty string. Rows with one key are taken in order of size; rows alike in both
    are interchangeable. Empty input gives no rows. ``digits`` hex digits of the key number
    the ranges of a source (16 ** digits of them).
    """
    words = F.coalesce(F.col(size), F.lit(0)).cast("long") if size else word_count(F.col("text"))
    keyed = docs.withColumn("_rl_size", words).withColumn("_rl_key", random_key(F.col("doc_id"), F.col(digest) if digest else F.md5(F.col("text")), seed)).withColumn("_rl_range", F.substring("_rl_key", 1, digits))
    ranges = staged(keyed.groupBy("source", "_rl_range").agg(F.sum("_rl_size").alias("_rl_words")), "mix-ranges")
    sizes = ranges.groupBy("source").agg(F.sum("_rl_words").alias("source_size"))
    targets = source_targets(sizes, share, epochs, weights)
    earlier = Window.partitionBy("source").orderBy("_rl_range").rowsBetween(Window.unboundedPreceding, -1)
    cut = ranges.withColumn("_rl_before", F.coalesce(F.sum("_rl_words").over(earlier), F.lit(0))).alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    cut = cut.select(F.col("r.source").alias("_rl_source"), F.col("_rl_range").alias("_rl_of"), "_rl_before", F.col("source_size").alias("_rl_total"), F.col("target").alias("_rl_target"))
    joined = keyed.drop("size", "source_size", "target", "taken").join(cut, F.col("source").eqNullSafe(F.col("_rl_source")) & (F.col("_rl_range") == F.col("_rl_of")))
    inside = Window.partitionBy("source", "_rl_range").orderBy("_rl_key", "_rl_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("_rl_before") + F.sum("_rl_size").over(inside) - F.col("_rl_size")
    goal = F.floor(F.col("_rl_target") + 0.5)
    whole = F.when(F.col("_rl_total") > 0, F.floor(goal / F.col("_rl_total"))).otherwise(0)
    rest = goal - whole * F.col("_rl_total")
    taken = whole * F.col("_rl_size") + F.least(F.col("_rl_size"), F.greatest(F.lit(0), rest - F.col("_rl_at")))
    out = joined.withColumn("_rl_at", before).withColumns({"size": F.col("_rl_size"), "source_size": F.col("_rl_total"), "target": F.col("_rl_target"), "taken": taken.cast("long"), "_rl_epochs": whole.cast("int")})
    return out.drop("_rl_size", "_rl_key", "_rl_range", "_rl_source", "_rl_of", "_rl_before", "_rl_total", "_rl_target", "_rl_at")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as its taken words fill it, to the nearest whole; columns of ``docs``.

    A document without words comes once for each whole epoch of its source.
    """
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.col("_rl_epochs")).cast("int")
    # names that mix() adds are carried under another name meanwhile
    clash = [c for c in docs.columns if c in ("size", "source_size", "target", "taken")]
    held = docs.withColumnsRenamed({c: f"_rl_own_{c}" for c in clash})
    out = mix(held, **options).withColumn("_rl_copies", copies).filter("_rl_copies > 0")
    out = out.withColumn("_rl_copy", F.explode(F.sequence(F.lit(1), F.col("_rl_copies"))))
    return out.select(*[F.col(f"_rl_own_{c}").alias(c) if c in clash else F.col(c) for c in docs.columns])


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '') || ':mix') AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
f AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                / (sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM r),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(max(lev) OVER (), 0.0::DOUBLE) * w) AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS goal,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * size + least(size, greatest(0, goal - (goal // source_size) * source_size - before)) END::BIGINT AS taken
FROM p
"""
