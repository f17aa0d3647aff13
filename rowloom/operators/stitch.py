"""Stitching overlapping pages of rows by their content.

Neighbouring pages of one batch may overlap: the last k rows of a page are the first k of the
next. Each k is judged from the scores of its row pairs; accepted overlaps give each row a
global position by one running sum over the pages, so no graph search is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.operators.agreement import overlap_score

#: Thresholds of the overlap rules (fixed values).
ONE_ROW, MEAN, LEAST = 0.89, 0.77, 0.72
LONGEST = 11


def page_pairs(rows: DataFrame) -> DataFrame:
    """Pages with their neighbour: batch, page, size, next_size; pages in order of ``page`` within the batch.

    rows: batch, page, row (1, 2, ...), payload, and ``tab`` where pages have one.
    """
    tab = F.max("tab") if "tab" in rows.columns else F.lit(None).cast("string")
    pages = rows.groupBy("batch", "page").agg(F.count("*").alias("size"), tab.alias("tab"))
    near = Window.partitionBy("batch").orderBy("page")
    following = F.lead(F.struct("page", "size", "tab")).over(near)
    return pages.withColumn("next", following).select("batch", "page", "size", "tab", F.col("next.page").alias("next_page"), F.col("next.size").alias("next_size"), F.col("next.tab").alias("next_tab"))


def row_pairs(rows: DataFrame, longest: int) -> DataFrame:
    """For each page and k the k pairs of its last rows with the next page's first: batch, page, k, a and b (structs of payload).

    Rows are dealt by batch once; a page holds its last rows and its neighbour's first, and makes its pairs from these without a join.
    """
    tab = F.max("tab") if "tab" in rows.columns else F.lit(None).cast("string")
    held = rows.filter("batch is not null and page is not null").repartition("batch")
    pages = held.groupBy("batch", "page").agg(F.count("*").alias("size"), tab.alias("tab"), F.collect_list(F.struct("row", "payload")).alias("all"))
    near = Window.partitionBy("batch").orderBy("page")
    pages = pages.withColumn("next", F.lead(F.struct("size", "tab", F.filter("all", lambda r: r["row"] <= longest).alias("head"))).over(near)).filter("next is not null")
    pages = pages.filter(F.col("tab").isNull() | F.col("next.tab").isNull() | (F.col("tab") == F.col("next.tab")))
    # the pair of a page's row a with the next one's row b belongs to the k that puts both in one place
    most = F.least(F.lit(longest), F.col("size"), F.col("next.size"))
    tail = F.filter("all", lambda r: r["row"] > F.col("size") - longest)
    k = lambda a, b: (F.col("size") - a["row"] + b["row"]).cast("int")
    pair = lambda a, b: F.struct(k(a, b).alias("k"), a["row"].alias("row_a"), b["row"].alias("row_b"), F.struct(a["payload"].alias("payload")).alias("a"), F.struct(b["payload"].alias("payload")).alias("b"))
    pairs = F.flatten(F.transform(tail, lambda a: F.transform(F.filter(F.col("next.head"), lambda b: k(a, b) <= most), lambda b: pair(a, b))))
    return pages.select("batch", "page", F.explode(pairs).alias("pair")).select("batch", "page", "pair.*")


def overlap_options(rows: DataFrame, score: Column, longest: int = LONGEST) -> DataFrame:
    """For each page and k the mean and least score of the k row pairs at its end; ``score`` compares a.payload with b.payload."""
    return row_pairs(rows, longest).select("batch", "page", "k", score.alias("s")).groupBy("batch", "page", "k").agg(F.avg("s").alias("mean"), F.min("s").alias("least"))


def accepted_overlaps(options: DataFrame) -> DataFrame:
    """The best k of each page that passes the rules and is decisive against the best other k: batch, page, k, mean, least."""
    passes = F.when(F.col("k") == 1, F.col("mean") >= ONE_ROW).otherwise((F.col("mean") >= MEAN) & (F.col("least") >= LEAST))
    rank = F.col("mean") + F.least(F.lit(0.025), F.col("k") * 0.004)
    best = F.max_by(F.struct("k", "mean", "least"), F.when(passes, F.struct(rank.alias("r"), F.col("k").alias("k"))))
    per_page = options.groupBy("batch", "page").agg(best.alias("best"), F.collect_list(F.struct("k", "mean")).alias("all"), F.max(passes).alias("any"))
    rival = F.array_max(F.transform(F.filter("all", lambda o: (o["k"] != F.col("best.k")) & (o["mean"] >= 0.65)), lambda o: o["mean"]))
    strong = F.when(F.col("best.k") == 1, F.col("best.mean") >= 0.925).when(F.col("best.k") >= 4, F.lit(True)).otherwise((F.col("best.mean") >= 0.805) & (F.col("best.least") >= 0.75))
    clear = rival.isNull() | (F.col("best.mean") - rival >= 0.055) | (F.col("best.mean") >= 0.94)
    return per_page.filter(F.col("any") & strong & clear).select("batch", "page", "best.*")


def positions(rows: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Every row with its global position in the batch: rows that overlap share one."""
    pages = page_pairs(rows).select("batch", "page", "size")
    o = overlaps.select(F.col("batch").alias("_b"), F.col("page").alias("_p"), "k")
    joined = pages.join(o, (F.col("batch") == F.col("_b")) & (F.col("page") == F.col("_p")), "left")
    before = Window.partitionBy("batch").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = joined.select(F.col("batch").alias("_b"), F.col("page").alias("_p"), F.coalesce(F.sum(F.col("size") - F.coalesce("k", F.lit(0))).over(before), F.lit(0)).alias("start"))
    out = rows.join(starts, (F.col("batch") == F.col("_b")) & (F.col("page") == F.col("_p")))
    return out.withColumn("position", F.col("start") + F.col("row")).drop("_b", "_p", "start")


def unique_rows(placed: DataFrame, quality: Column) -> DataFrame:
    """One copy per position, the best by quality, of equals the first page's: batch, position, copies, page, row, payload."""
    best = F.max_by(F.struct("page", "row", "payload"), F.struct(quality.alias("q"), (-F.col("page")).alias("p")))
    return placed.groupBy("batch", "position").agg(F.count("*").alias("copies"), best.alias("best")).select("batch", "position", "copies", "best.*")


def stitch(rows: DataFrame, score: Column, quality: Column | None = None) -> DataFrame:
    """Unique rows of all batches. Batches never merge with each other."""
    overlaps = accepted_overlaps(overlap_options(rows, score))
    return unique_rows(positions(rows, overlaps), F.lit(0) if quality is None else quality)


def planned_options(rows: DataFrame, visual: Column, agree: Column, longest: int = 10) -> DataFrame:
    """Overlaps that a boundary may have: batch, page, k, score, strict; k = 0 isn't listed.

    ``visual`` and ``agree`` compare a.payload with b.payload. Any conflict (agreement below 0) rules a k out.
    Strict ones look alike throughout; supported ones, of two rows or more, are backed by
    agreement and cost 0.035. Scores have nine decimals.
    """
    total = overlap_score(visual, agree)
    per = row_pairs(rows, longest).select("batch", "page", "k", total.alias("s"), agree.alias("g")).groupBy("batch", "page", "k").agg(F.round(F.avg("s"), 9).alias("mean"), F.min("s").alias("least"), F.round(F.avg("g"), 9).alias("agree"), F.min("g").alias("worst"))
    strict = F.when(F.col("k") == 1, F.col("mean") >= 0.985).otherwise((F.col("mean") >= 0.90) & (F.col("least") >= 0.79))
    supported = (F.col("k") >= 2) & (F.col("mean") >= 0.77) & (F.col("least") >= 0.68) & (F.col("agree") >= 0.18)
    kept = per.filter((F.col("worst") >= 0) & (strict | supported))
    return kept.select("batch", "page", "k", F.round(F.col("mean") - F.when(strict, 0.0).otherwise(0.035), 9).alias("score"), strict.alias("strict"))


def plan_overlaps(rows: DataFrame, options: DataFrame, expected: DataFrame) -> DataFrame:
    """One overlap for each boundary: batch, need, planned, ks (in order of the pages).

    expected: batch, total (null or 0: unknown). The overlaps have to sum to ``need``, the rows
    that are too many; of such plans the one with the largest sum of score times k is taken, and
    of equal ones that whose later boundaries take the option listed first. An ordered fold over a
    batch's boundaries keeps, for each sum up to ``need``, its best score and plan, so a batch costs
    boundaries times need times options. Where no plan reaches ``need``, or it is 0, each
    boundary takes its first overlap: strict ones first, then by score, then the longer one.
    """
    pages = page_pairs(rows)
    rank = F.struct((~F.col("strict")).alias("loose"), (-F.col("score")).alias("down"), (-F.col("k")).alias("short"), F.col("k"), F.col("score"))
    none = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("score"))
    listed = options.groupBy(F.col("batch").alias("_b"), F.col("page").alias("_p")).agg(F.transform(F.array_sort(F.collect_list(rank)), lambda o: F.struct(o["k"].alias("k"), o["score"].alias("score"))).alias("listed"))
    bounds = pages.filter("next_page is not null").join(listed, F.col("batch").eqNullSafe(F.col("_b")) & (F.col("page") == F.col("_p")), "left").drop("_b", "_p")
    whole = F.concat(F.coalesce("listed", F.array().cast("array<struct<k:int,score:double>>")), F.array(none))
    per = bounds.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("page", whole.alias("options")))).alias("bounds"))
    sizes = pages.groupBy("batch").agg(F.sum("size").alias("size"))
    need = F.when(F.coalesce("total", F.lit(0)) > 0, F.greatest(F.lit(0), F.col("size") - F.col("total"))).otherwise(0).cast("int")
    joined = sizes.join(expected.select(F.col("batch").alias("_b"), "total"), F.col("batch").eqNullSafe(F.col("_b")), "left").drop("_b").withColumn("need", need)
    joined = joined.join(per.withColumnRenamed("batch", "_b"), F.col("batch").eqNullSafe(F.col("_b")), "left").withColumn("bounds", F.coalesce("bounds", F.array().cast(per.schema["bounds"].dataType)))
    state = "struct<score:double,ks:array<int>>"
    sums = F.sequence(F.lit(0), F.col("need"))
    start = F.transform(sums, lambda s: F.when(s == 0, F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ks"))).cast(state))

    def better(best: Column, before: Column, o: Column) -> Column:
        score = before["score"] + o["score"] * o["k"]
        wins = before.isNotNull() & (best.isNull() | (score > best["score"]))
        return F.when(wins, F.struct(score.alias("score"), F.array_append(before["ks"], o["k"]).alias("ks")).cast(state)).otherwise(best)

    def step(acc: Column, bound: Column) -> Column:
        return F.transform(sums, lambda s: F.reduce(bound["options"], F.lit(None).cast(state), lambda best, o: better(best, F.get(acc, s - o["k"]), o)))

    plan = F.get(F.reduce("bounds", start, step), F.col("need"))
    own = F.transform("bounds", lambda b: F.get(b["options"], 0)["k"])
    planned = (F.col("need") > 0) & F.col("plan").isNotNull()
    return joined.withColumn("plan", plan).select("batch", "need", planned.alias("planned"), F.when(planned, F.col("plan.ks")).otherwise(own).alias("ks"))
