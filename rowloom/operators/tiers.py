"""Evidence tiers of result rows: mode, caps, collisions and statistics. The order of the steps matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_in_range(values: DataFrame, value: str, group: list[str], low: int = 20, high: int = 200) -> DataFrame:
    """The most frequent value from ``low`` to ``high`` in each group, of equals the larger."""
    counts = values.filter(F.col(value).between(low, high)).groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.max_by(F.struct(value, "n"), F.struct("n", value)).alias("m")).select(*group, "m.*")


def flag_unrecognised(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows without a match whose best score is below ``least`` lose their tentative result."""
    weak = F.col("match").isNull() & (F.coalesce("score", F.lit(0.0)) < least)
    return rows.withColumns({"unrecognised": weak, "resolved": F.when(~weak, F.col("resolved"))})


def cap(rows: DataFrame, total: Column, scope: list[str], order: str = "first_index") -> DataFrame:
    """The strongest ``total`` rows of each scope: matches, then tentative ones, then others, by score, then order.

    Totals outside 20 to 200 cap nothing. Ranks need each scope's rows in order: pass the batch
    as the scope, which bounds it.
    """
    tier = F.when(F.col("match").isNotNull(), 3).when(F.col("resolved").isNotNull(), 2).otherwise(1)
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(tier.desc(), F.coalesce("score", F.lit(0.0)).desc(), F.coalesce(F.col(order), F.lit(9999))))
    return rows.withColumn("_rank", rank).filter(~F.coalesce(total.between(20, 200), F.lit(False)) | (F.col("_rank") <= total)).drop("_rank")


def demote_collisions(rows: DataFrame, batch: str, name: Column) -> DataFrame:
    """Matches of one name in one batch, if more than one, all lose their match and become candidates.

    Names are counted by an aggregate and joined back, so one common name costs no single task.
    """
    named = rows.withColumn("_name", F.when(F.col("match").isNotNull(), name))
    many = named.filter("_name is not null").groupBy(F.col(batch).alias("_b"), F.col("_name").alias("_n")).count().filter("count > 1").select("_b", "_n", F.lit(True).alias("_many"))
    out = named.join(many, (F.col(batch) == F.col("_b")) & (F.col("_name") == F.col("_n")), "left")
    hit = F.coalesce("_many", F.lit(False))
    return out.withColumns({"match": F.when(~hit, F.col("match")), "status": F.when(hit, "候選").otherwise(F.col("status"))}).drop("_name", "_b", "_n", "_many")


def drop_confirmed_elsewhere(rows: DataFrame, batch: str) -> DataFrame:
    """Tentative results that another row of the batch has as a match go."""
    confirmed = rows.filter("match is not null").select(F.col(batch).alias("_b"), F.col("match").alias("_m")).distinct().withColumn("_taken", F.lit(True))
    out = rows.join(confirmed, (F.col(batch) == F.col("_b")) & (F.col("resolved") == F.col("_m")), "left")
    return out.withColumn("resolved", F.when(F.col("_taken").isNull(), F.col("resolved"))).drop("_b", "_m", "_taken")


def finish(rows: DataFrame, batch: str, name: Column, total: Column, scope: list[str]) -> DataFrame:
    """All steps in order: unrecognised, cap, collisions, tentative results taken elsewhere."""
    return drop_confirmed_elsewhere(demote_collisions(cap(flag_unrecognised(rows), total, scope), batch, name), batch)


def statistics(rows: DataFrame, batch: str, raw: str | None = None) -> DataFrame:
    """Rows, confirmed, tentative and pending rows of each batch; raw: a column of copies to sum."""
    confirmed, inferred = F.col("match").isNotNull(), F.col("match").isNull() & F.col("resolved").isNotNull()
    return rows.groupBy(batch).agg(
        (F.sum(raw) if raw else F.count("*")).cast("long").alias("raw"),
        F.count("*").alias("unique_rows"),
        F.count_if(confirmed).alias("confirmed"),
        F.count_if(inferred).alias("tentative"),
        F.count_if(~confirmed & ~inferred).alias("pending"),
    )


def display_value(match: Column, resolved: Column, first: Column, unrecognised: Column) -> Column:
    """What a row shows: match, tentative result or first candidate; nothing where unrecognised."""
    return F.when(unrecognised, F.lit(None)).otherwise(F.coalesce(match, resolved, first))


def position_group(category: Column, position: Column) -> Column:
    """The screen category, else the group of the position, else to be confirmed."""
    infield = position.isin("一壘手", "二壘手", "三壘手", "游擊手")
    return F.coalesce(F.nullif(category, F.lit("")), F.when(infield, "內野手").when(position.isin("投手", "捕手", "外野手"), position), F.lit("待確認守位"))


def merge_evidence(rows: DataFrame, key: str, order: str, scalar: str, tag: str, score: str) -> DataFrame:
    """One row per key: tags united, first non-empty scalar, best score, first index, number of rows."""
    filled = F.when(F.coalesce(F.col(scalar), F.lit("")) != "", F.col(scalar))
    return rows.groupBy(key).agg(
        F.sort_array(F.collect_set(tag)).alias("tags"),
        F.min_by(filled, F.when(filled.isNotNull(), F.col(order))).alias("first_value"),
        F.max(score).alias("best"),
        F.min(order).alias("first_index"),
        F.count("*").alias("n"),
    )


def as_evidence(readings: DataFrame, key: str, order: str) -> DataFrame:
    """The readings of each key as one: key, names, families, givens, family, given, position, hand, age, confidence, first_index, n.

    readings: key, order (tells the readings of a key apart), family, given, position, hand, age, confidence; blank is unknown. Arrays hold what was read, each
    once, in the order of first reading; a scalar is the first that is known; the confidence is the largest. All are
    aggregates that combine before the shuffle, and none depends on the order of rows.
    """
    known = lambda c: F.nullif(F.col(c), F.lit(""))
    name = F.nullif(F.concat(F.coalesce("family", F.lit("")), F.coalesce("given", F.lit(""))), F.lit(""))
    read = lambda v: F.collect_set(F.when(v.isNotNull(), F.struct(F.col(order).alias("o"), v.alias("v"))))
    first = lambda v: F.min_by(v, F.when(v.isNotNull(), F.col(order)))
    once = lambda c: F.array_distinct(F.transform(F.array_sort(c), lambda x: x["v"]))
    per = readings.groupBy(F.col(key).alias("key")).agg(
        read(name).alias("names"),
        read(known("family")).alias("families"),
        read(known("given")).alias("givens"),
        first(known("position")).alias("position"),
        first(known("hand")).alias("hand"),
        first(F.col("age")).alias("age"),
        F.max("confidence").alias("confidence"),
        F.min(order).alias("first_index"),
        F.count("*").alias("n"),
    )
    per = per.withColumns({c: once(c) for c in ("names", "families", "givens")})
    return per.withColumns({"family": F.get("families", 0), "given": F.get("givens", 0), "position": F.coalesce("position", F.lit("")), "hand": F.coalesce("hand", F.lit(""))})
