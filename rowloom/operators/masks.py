"""Bit masks of rows: packed as one long for each line, compared at small shifts by AND and popcount; overlap edges by two lines of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.numbers import let
from rowloom.operators.stitch import MEAN, LEAST, ONE_ROW

#: Shifts that are tried: lines first, then columns around the best line shift; the least likeness for that second step (fixed values).
LINES, COLUMNS, GO_ON = 3, (-4, -2, -1, 1, 2, 4), 0.53


def pack(bits: Column) -> Column:
    """An array of booleans as a long, the first one lowest; 62 at most."""
    return F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda acc, b: acc * 2 + F.when(b, 1).otherwise(0))


def ink(mask: Column) -> Column:
    """Set bits of a mask."""
    return F.aggregate(F.transform(mask, lambda line: F.bit_count(line)), F.lit(0), lambda s, n: s + n)


def unless_blank(mask: Column, width: int, height: int, least: int = 36, most: float = 0.46) -> Column:
    """The mask, null where so little or so much is set that it shows no name."""
    return let(ink(mask), lambda n: F.when((n >= least) & (n <= most * width * height), mask))


def moved(mask: Column, by: int, width: int) -> Column:
    """Every line moved by so many columns; what leaves the width is lost."""
    full = (1 << width) - 1
    return F.transform(mask, lambda line: F.shiftleft(line, by).bitwiseAND(F.lit(full)) if by > 0 else F.shiftright(line, -by))


def hits(a: Column, b: Column, lines: Column) -> Column:
    """Bits that ``a`` and ``b``, moved down by ``lines``, both have."""
    size = F.size(a) - F.abs(lines)
    both = F.zip_with(F.slice(a, F.greatest(lines, F.lit(0)) + 1, size), F.slice(b, F.greatest(-lines, F.lit(0)) + 1, size), lambda x, y: F.bit_count(x.bitwiseAND(y)))
    return F.aggregate(both, F.lit(0), lambda s, n: s + n)


def shift_likeness(a: Column, b: Column, width: int) -> Column:
    """Largest Dice coefficient of two masks of one height over small shifts; 0 where either is null or empty.

    Shifts by lines come first. From 0.53 on, shifts by columns at the best line shift and its neighbours follow.
    """

    def searched(total: Column) -> Column:
        dice = lambda x, dy: hits(a, x, dy) * 2 / total
        upright = F.transform(F.sequence(F.lit(-LINES), F.lit(LINES)), lambda dy: dice(b, dy))

        def around(found: Column) -> Column:
            best = F.array_max(found)
            at = (F.array_position(found, best) - LINES - 1).cast("int")
            near = F.sequence(F.greatest(F.lit(-LINES), at - 1), F.least(F.lit(LINES), at + 1))
            aside = [let(moved(b, dx, width), lambda x: F.array_max(F.transform(near, lambda dy: dice(x, dy)))) for dx in COLUMNS]
            return F.when(best < GO_ON, best).otherwise(F.greatest(best, *aside))

        return let(upright, around)

    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(let(ink(a) + ink(b), lambda total: F.when(total > 0, searched(total)).otherwise(0.0)))


def edge_options(pairs: DataFrame, pixel: Column, shape: Column) -> DataFrame:
    """Per page and k what the k row pairs say: batch, page, k, mean, least and widest of ``pixel``, shape_mean and shape_least.

    pairs: as of stitch.row_pairs(); each pair of rows belongs to one k, so none is scored twice.
    """
    scored = pairs.select("batch", "page", "k", pixel.alias("p"), shape.alias("s"))
    per = scored.groupBy("batch", "page", "k").agg(F.round(F.avg("p"), 9).alias("mean"), F.min("p").alias("least"), F.max("p").alias("widest"), F.round(F.avg("s"), 9).alias("shape_mean"), F.min("s").alias("shape_least"))
    return per


def decide_edges(options: DataFrame) -> DataFrame:
    """The overlap of each page that has one: batch, page, k, mean, least, method ('pixel' or 'shape+pixel').

    Pixels decide where their best overlap is decisive. Else the overlap by shapes, if that is
    clear among those by shapes, is trusted by one of three rules, unless a rival stands within 0.055 of the
    pixels' best: shapes alone are strong; one row, alike by pixels and well ahead of the neighbouring pairs;
    two rows or more, of weaker shapes, that pixels back. A neighbouring pair beyond either page counts as 0.
    """
    k, mean, least = F.col("k"), F.col("mean"), F.col("least")
    passes = F.when(k == 1, mean >= ONE_ROW).otherwise((mean >= MEAN) & (least >= LEAST))
    shaped = F.when(k == 1, F.col("shape_mean") >= 0.745).otherwise((F.col("shape_mean") >= 0.67) & (F.col("shape_least") >= 0.58))
    rank = F.struct((mean + F.least(F.lit(0.025), k * 0.004)).alias("r"), k)
    whole = F.struct("k", "mean", "least", "shape_mean", "shape_least")
    shapes = F.array_sort(F.collect_list(F.when(shaped, F.struct((-F.col("shape_mean")).alias("down"), (-k).alias("short"), whole.alias("o")))))
    per = options.groupBy("batch", "page").agg(
        F.max_by(whole, F.when(passes, rank)).alias("px"),
        F.collect_list(F.struct("k", "mean")).alias("all"),
        shapes.alias("shapes"),
        F.max(F.when(k == 1, mean)).alias("direct"),
        F.max(F.when(k == 2, F.col("widest"))).alias("near"),
    )
    px = F.col("px")
    rival = F.array_max(F.transform(F.filter("all", lambda o: (o["k"] != px["k"]) & (o["mean"] >= 0.65)), lambda o: o["mean"]))
    per = per.withColumn("rival", rival)
    clear = F.col("rival").isNull() | (F.round(px["mean"] - F.col("rival"), 9) >= 0.055)
    strong = F.when(px["k"] == 1, px["mean"] >= 0.925).when(px["k"] >= 4, (px["mean"] >= MEAN) & (px["least"] >= LEAST)).otherwise((px["mean"] >= 0.805) & (px["least"] >= 0.75))
    decisive = F.coalesce(strong & (clear | (px["mean"] >= 0.94)), F.lit(False))
    first, second = F.get("shapes", 0)["o"], F.get("shapes", 1)["o"]
    ahead = (F.round(first["shape_mean"] - F.coalesce(second["shape_mean"], F.lit(0.0)), 9) >= 0.06) | (first["shape_mean"] >= 0.90)
    alone = (first["shape_mean"] >= 0.81) & (first["shape_least"] >= 0.76)
    near = F.coalesce("near", F.lit(0.0))
    single = (first["k"] == 1) & (first["shape_mean"] >= 0.76) & (F.col("direct") >= 0.79) & (F.round(F.col("direct") - near, 9) >= 0.055)
    several = (first["k"] >= 2) & (first["shape_mean"] >= 0.70) & (first["shape_least"] >= 0.60) & (first["mean"] >= 0.68)
    trusted = F.coalesce(ahead & (px.isNull() | clear) & (alone | single | several), F.lit(False))
    by_shape = F.struct(first["k"].alias("k"), first["shape_mean"].alias("mean"), first["shape_least"].alias("least"), F.when(alone, "alone").when(single, "single").otherwise("several").alias("rule"))
    by_pixel = F.struct(px["k"].alias("k"), px["mean"].alias("mean"), px["least"].alias("least"), F.lit("pixel").alias("rule"))
    chosen = per.select("batch", "page", F.when(decisive, by_pixel).when(trusted, by_shape).alias("c")).filter("c is not null")
    return chosen.select("batch", "page", "c.*").withColumn("method", F.when(F.col("rule") == "pixel", "pixel").otherwise("shape+pixel"))
