"""Rules over attempts and evidence: which attempt to trust, what sources agree on, one row per identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_attempt(attempts: DataFrame, row: str = "row") -> DataFrame:
    """The attempt to trust of each row: row, uid, score, margin, matched, step, rule.

    attempts: row, ``step`` (order of trial), uid, score, margin and ``matched``; attempts
    without a score don't count. A first attempt that is a match from 0.70 with a margin from 0.18 ends
    the search (``first``). Else, where the best attempt is no match, a confirmed one within
    0.055 of it that has the same uid wins (``confirmed``), and else the best (``best``). Of equals the earlier wins.
    """
    real = attempts.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    whole = F.struct("uid", "score", "margin", "matched", "step")
    order = F.struct(F.col("score"), -F.col("step"))
    per = real.groupBy(row).agg(
        F.max_by(whole, F.when((F.col("step") == 0) & F.col("matched") & (F.col("score") >= 0.70) & (F.col("margin") >= 0.18), order)).alias("first"),
        F.max_by(whole, order).alias("best"),
        F.max_by(whole, F.when(F.col("matched"), order)).alias("confirmed"),
    )
    kept = ~F.col("best.matched") & (F.col("confirmed.score") >= F.col("best.score") - 0.055) & (F.col("confirmed.uid") == F.col("best.uid"))
    rule = F.when(F.col("first").isNotNull(), "first").when(F.coalesce(kept, F.lit(False)), "confirmed").otherwise("best")
    chosen = F.when(rule == "first", F.col("first")).when(rule == "confirmed", F.col("confirmed")).otherwise(F.col("best"))
    return per.select(row, chosen.alias("c"), rule.alias("rule")).select(row, "c.*", "rule")


def retry_wins(score: Column, matched: Column, again: Column, again_matched: Column) -> Column:
    """Whether a second pass over the whole roster replaces a weak first one."""
    return F.coalesce(again.isNotNull() & ((again >= score + 0.02) | (~matched & again_matched)), F.lit(False))


def needs_retry(category: Column, matched: Column, margin: Column, score: Column) -> Column:
    """Whether a first pass within a category is weak enough for a second one."""
    weak = ~matched | (F.coalesce(margin, F.lit(0.0)) < 0.16) | (F.coalesce(score, F.lit(0.0)) < 0.67)
    return (F.coalesce(category, F.lit("")) != "") & weak


def copy_wins(p: Column, other: Column) -> Column:
    """Whether another copy of the row replaces it. p, other: structs of uid, score and matched, null for no candidate."""
    same = p["uid"] == other["uid"]
    better = (other["score"] > p["score"] + 0.055) | (other["matched"] & ~p["matched"] & same & (other["score"] >= p["score"] - 0.055))
    return F.coalesce(other["uid"].isNotNull() & (p["uid"].isNull() | better), F.lit(False))


def half_width_accept(name: Column, score: Column, margin: Column, same_name: Column, fits: Column) -> Column:
    """Acceptance of a half-width reading: unique, fitting, and by the limits of names that mix scripts or don't."""
    mixed = name.rlike("[^A-Za-z]")
    rule = F.when(mixed, (score >= 0.58) & (margin * F.length(name) >= 0.25)).otherwise((score >= 0.55) & (margin >= 0.12))
    return F.coalesce((same_name == 1) & fits & rule, F.lit(False))


def is_latin(name: Column) -> Column:
    """Names that the half-width reading may take: Latin ones of two letters or more, mixed ones of three signs or more."""
    return name.rlike("^[A-Za-z]{2,}$") | (name.rlike("[A-Za-z]") & (F.length(name) >= 3))


def independent_agreement(rows: DataFrame, evidence: DataFrame, row: str = "row") -> DataFrame:
    """``agreed``: how many sources of a row support its best candidate, 0 unless two or more do without conflict.

    rows: row, uid (best candidate, null for none). evidence: row, uid, look (visual score),
    position, hand; blank positions and hands are unknown. Support needs the same uid and a look from 0.59.
    """
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    best = rows.filter(F.col("uid").isNotNull()).select(F.col(row).alias("_r"), F.col("uid").alias("_u"))
    on = (F.col(row) == F.col("_r")) & (F.col("uid") == F.col("_u")) & (F.coalesce("look", F.lit(0.0)) >= 0.59)
    found = evidence.join(best, on).groupBy(F.col(row).alias("_r")).agg(F.count("*").alias("n"), F.min(known("position")).alias("p1"), F.max(known("position")).alias("p2"), F.min(known("hand")).alias("h1"), F.max(known("hand")).alias("h2"))
    clear = F.coalesce(F.col("p1") == F.col("p2"), F.lit(True)) & F.coalesce(F.col("h1") == F.col("h2"), F.lit(True)) & (F.col("n") >= 2)
    told = found.select("_r", F.when(clear, F.col("n")).otherwise(0).alias("agreed"))
    return rows.join(told, F.col(row) == F.col("_r"), "left").drop("_r").withColumn("agreed", F.coalesce("agreed", F.lit(0)).cast("long"))


def best_per_identity(rows: DataFrame, uid: str, score: str, confidence: str, order: str, group: list[str]) -> DataFrame:
    """One row per identity of each group, that of the best quality (score + confidence / 5000), the earliest of equals; rows without identity all stay."""
    quality = F.coalesce(F.col(score), F.lit(0.0)) + F.coalesce(F.col(confidence), F.lit(0.0)) / 5000
    named = rows.filter(F.col(uid).isNotNull())
    best = named.groupBy(*group, uid).agg(F.max_by(F.struct(*rows.columns), F.struct(quality, -F.col(order))).alias("_b")).select("_b.*")
    return best.unionByName(rows.filter(F.col(uid).isNull()))


def in_order(rows: DataFrame, order: str, total: Column, group: list[str]) -> DataFrame:
    """Rows with their ``place`` by ``order`` (null counts as 9999) within the group; places beyond ``total`` go, where it is above 0."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.coalesce(F.col(order), F.lit(9999)), *[F.col(c) for c in rows.columns if c not in (order, *group)][:1]))
    return rows.withColumn("place", place).filter((F.coalesce(total, F.lit(0)) <= 0) | (F.col("place") <= total))


def expected_total(values: DataFrame, group: list[str], value: str, fallback: Column) -> DataFrame:
    """The total that each group's readings speak for: group, ``total``.

    Readings from 20 to 200 count. The most frequent wins if it stands twice or more (of
    equals the nearest to ``fallback``, then the smaller); else ``fallback`` where a reading lies
    within 2 of it; else the upper median; ``fallback``, or 0, without any reading. fallback: a
    column of ``values`` that is the same in a group, null or 0 for none.
    """
    counts = values.groupBy(*group, F.nullif(fallback, F.lit(0)).alias("_f"), value).agg(F.count("*").alias("_n"))
    good = counts.withColumn("_good", F.coalesce(F.col(value).between(20, 200), F.lit(False)))
    away = F.abs(F.col(value) - F.coalesce("_f", value))
    rank = F.when(F.col("_good"), F.struct(F.col("_n"), -away, -F.col(value)))
    inside = Window.partitionBy(*group, "_f", "_good").orderBy(value)
    good = good.withColumns({"_run": F.sum("_n").over(inside), "_all": F.sum("_n").over(Window.partitionBy(*group, "_f", "_good"))})
    per = good.groupBy(*group, "_f").agg(
        F.max_by(F.struct(F.col(value).alias("v"), F.col("_n").alias("n")), rank).alias("top"),
        F.max(F.when(F.col("_good"), away <= 2)).alias("near"),
        F.min(F.when(F.col("_good") & (F.col("_run") > F.floor(F.col("_all") / 2)), F.col(value))).alias("median"),
    )
    total = F.when(F.col("median").isNull(), F.coalesce("_f", F.lit(0))).when(F.col("top.n") >= 2, F.col("top.v")).when(F.col("_f").isNotNull() & F.col("near"), F.col("_f")).otherwise(F.col("median"))
    return per.select(*group, total.cast("long").alias("total"))


def row_agreement(a: Column, b: Column) -> Column:
    """1 for the same identity, 0.72 for a shared one among the first five candidates, -0.35 for a conflict of position or hand, else 0.

    a, b: structs of uid, top (array of candidates), position, hand; blank is unknown.
    """
    differ = lambda c: (F.coalesce(a[c], F.lit("")) != "") & (F.coalesce(b[c], F.lit("")) != "") & (a[c] != b[c])
    shared = F.arrays_overlap(F.slice(a["top"], 1, 5), F.slice(b["top"], 1, 5))
    return F.when(a["uid"] == b["uid"], 1.0).when(F.coalesce(shared, F.lit(False)), 0.72).when(differ("position") | differ("hand"), -0.35).otherwise(0.0)


def overlap_score(visual: Column, agreement: Column) -> Column:
    """What looks and agreement together say about two rows being one, 0 to 1.15."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.15), visual + F.greatest(F.lit(0.0), agreement) * 0.12))


def shape_overlap(mean: Column, least: Column, gap: Column, k: Column) -> tuple[Column, Column]:
    """Whether an overlap of ``k`` rows is accepted by shapes alone, and whether that is decisive."""
    accepted = F.when(k == 1, mean >= 0.745).otherwise((mean >= 0.67) & (least >= 0.58))
    return accepted, accepted & ((F.coalesce(gap, F.lit(9.0)) >= 0.06) | (mean >= 0.90))
