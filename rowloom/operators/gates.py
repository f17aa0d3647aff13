"""Soft gates: a pool of records is narrowed step by step for each query, and only where something remains.

What a gate would leave is counted on aggregates of the roster, never on collected pools: records are
counted once by position, hand, family name and the lengths of both names, a cube adds "any
position" and "any hand", and a query joins the cells of its own gates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.text import name_similarity
from rowloom.operators.written import written

#: Least best similarity for a shortlist of family names, least of its members, how far they may stand behind the best, most records (fixed values).
SHORTLIST = (0.48, 0.42, 0.08, 220)


def known(value: Column) -> Column:
    """The value, null where it is empty."""
    return F.nullif(value, F.lit(""))


def narrowed(queries: DataFrame, roster: DataFrame, least_position: int = 1, least_hand: int = 1, least_lengths: int = 1) -> DataFrame:
    """What gates each query takes, one row each, and ``pool``, how many records all of them leave.

    queries: query_id, position, hand, family (keys as read; empty or null for unknown),
    family_length and given_length (null for unknown). roster: position, hand, family, given.
    Gates in order: position, hand, a shortlist of family names like the one read (see SHORTLIST), the family name's length
    and the given name's, both within 1. A gate is taken where the query knows its value and
    at least so many records remain, the shortlist where 1 to 220 do. Out: query_id, the flags
    by_position, by_hand, by_family, by_family_length, by_given_length, and the gates themselves, null where not taken: position, hand,
    families (the shortlist), family_length, given_length.

    Names are compared once for each different family name read and held; shortlists are made for each different position,
    hand and family name read, lengths counted for each different set of gates. So queries that ask alike cost no more than one.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    plain = roster.select(text("position").alias("position"), text("hand").alias("hand"), text("family").alias("family"), F.length(text("family")).alias("fl"), F.length(text("given")).alias("gl"))
    cells = plain.groupBy("position", "hand", "family", "fl", "gl").agg(F.count("*").alias("n"))
    cube = _cube(cells)
    sizes = cells.select(F.explode(_any_of()).alias("g"), "n").groupBy("g.p", "g.h").agg(F.sum("n").alias("n"))

    def size(q: DataFrame, position: Column, hand: Column, name: str) -> DataFrame:
        """Adds how many records hold that position and hand, null for any."""
        keyed = q.withColumns({"_kp": position, "_kh": hand})
        found = sizes.select(F.col("p").alias("_p"), F.col("h").alias("_h"), F.col("n").alias(name))
        return keyed.join(found, F.col("_kp").eqNullSafe(F.col("_p")) & F.col("_kh").eqNullSafe(F.col("_h")), "left").drop("_kp", "_kh", "_p", "_h")

    q = queries.select("query_id", known(F.col("position")).alias("position"), known(F.col("hand")).alias("hand"), known(F.col("family")).alias("read"), F.col("family_length").alias("_fl"), F.col("given_length").alias("_gl"))
    q = size(q, F.col("position"), F.lit(None).cast("string"), "_n")
    q = q.withColumn("by_position", F.coalesce(F.col("position").isNotNull() & (F.col("_n") >= least_position), F.lit(False))).drop("_n")
    q = q.withColumn("position", F.when(F.col("by_position"), F.col("position")))
    q = size(q, F.col("position"), F.col("hand"), "_n")
    q = q.withColumn("by_hand", F.coalesce(F.col("hand").isNotNull() & (F.col("_n") >= least_hand), F.lit(False))).drop("_n")
    q = q.withColumn("hand", F.when(F.col("by_hand"), F.col("hand")))
    q = written(q, "gated-queries")

    best_least, member, behind, most = SHORTLIST
    like = F.coalesce(F.round(name_similarity(F.col("read"), F.col("family")), 9), F.lit(0.0))
    alike = q.filter("read is not null").select("read").distinct().crossJoin(cells.select("family").distinct()).select("read", "family", like.alias("t"))
    alike = written(alike, "alike-families")
    held = cube.groupBy("p", "h", "family").agg(F.sum("n").alias("n"))
    asked = q.filter("read is not null").select("position", "hand", "read").distinct()
    near = asked.join(held, F.col("position").eqNullSafe(F.col("p")) & F.col("hand").eqNullSafe(F.col("h"))).drop("p", "h").join(alike, ["read", "family"])
    whole = Window.partitionBy("position", "hand", "read")
    near = near.withColumn("best", F.max("t").over(whole)).filter((F.col("best") >= best_least) & (F.col("t") >= F.greatest(F.lit(member), F.round(F.col("best") - behind, 9))))
    near = near.withColumn("left", F.sum("n").over(whole)).filter(F.col("left") <= most)
    short = near.groupBy("position", "hand", "read").agg(F.collect_list("family").alias("families"))
    short = written(short, "shortlists").select(F.col("position").alias("_p"), F.col("hand").alias("_h"), F.col("read").alias("_r"), "families")
    gates = F.col("position").eqNullSafe(F.col("_p")) & F.col("hand").eqNullSafe(F.col("_h"))
    q = q.join(short, gates & (F.col("read") == F.col("_r")), "left").drop("_p", "_h", "_r").withColumn("by_family", F.col("families").isNotNull())
    q = q.withColumn("read", F.when(F.col("by_family"), F.col("read")))

    lengths = cube.groupBy("p", "h", F.lit(None).cast("string").alias("r"), "fl", "gl").agg(F.sum("n").alias("n"))
    listed = short.select("_p", "_h", "_r", F.explode("families").alias("_f"))
    few = listed.join(cube, F.col("_p").eqNullSafe(F.col("p")) & F.col("_h").eqNullSafe(F.col("h")) & (F.col("_f") == F.col("family")))
    few = few.groupBy("p", "h", F.col("_r").alias("r"), "fl", "gl").agg(F.sum("n").alias("n"))
    kinds = q.select("position", "hand", "read", "_fl", "_gl").distinct()
    met = kinds.join(lengths.unionByName(few), F.col("position").eqNullSafe(F.col("p")) & F.col("hand").eqNullSafe(F.col("h")) & F.col("read").eqNullSafe(F.col("r")))
    family, given = F.abs(F.col("fl") - F.col("_fl")) <= 1, F.abs(F.col("gl") - F.col("_gl")) <= 1
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    counts = met.groupBy("position", "hand", "read", "_fl", "_gl").agg(F.sum("n").alias("any"), n(family).alias("f"), n(given).alias("g"), n(family & given).alias("fg"))
    counts = counts.withColumn("by_family_length", F.col("_fl").isNotNull() & (F.col("f") >= least_lengths))
    counts = counts.withColumns({"any": F.when(F.col("by_family_length"), F.col("f")).otherwise(F.col("any")), "left": F.when(F.col("by_family_length"), F.col("fg")).otherwise(F.col("g"))})
    counts = counts.withColumn("by_given_length", F.col("_gl").isNotNull() & (F.col("left") >= least_lengths))
    counts = counts.withColumn("pool", F.when(F.col("by_given_length"), F.col("left")).otherwise(F.col("any"))).filter("pool > 0").drop("any", "f", "g", "fg", "left")
    keys = ("position", "hand", "read", "_fl", "_gl")
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_k{c}"))
    done = q.join(counts.withColumnsRenamed({c: f"_k{c}" for c in keys}), same)
    taken = lambda c: F.when(F.col(f"by_{c}"), F.col("_fl" if c == "family_length" else "_gl")).alias(c)
    return done.select("query_id", *FLAGS, "position", "hand", "families", taken("family_length"), taken("given_length"), "pool")


FLAGS = ("by_position", "by_hand", "by_family", "by_family_length", "by_given_length")


def _any_of() -> Column:
    """A cell's position and hand with any position, any hand and any of both."""
    kind = lambda position, hand: F.struct(position.alias("p"), hand.alias("h")).cast("struct<p:string,h:string>")
    none = F.lit(None).cast("string")
    return F.array(kind(F.col("position"), F.col("hand")), kind(none, F.col("hand")), kind(F.col("position"), none), kind(none, none))


def _cube(cells: DataFrame) -> DataFrame:
    """The cells' records (n) by position and hand, null for any, family name and both lengths."""
    return cells.select(F.explode(_any_of()).alias("g"), "family", "fl", "gl", "n").groupBy("g.p", "g.h", "family", "fl", "gl").agg(F.sum("n").alias("n"))


def narrowed_cells(queries: DataFrame, roster: DataFrame, least_position: int = 1, least_hand: int = 1, least_lengths: int = 1) -> DataFrame:
    """The cells of the roster that each query's gates leave: of narrowed(), for each of a query's cells the flags, position and hand, family, family_length, given_length and ``pool``."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    plain = roster.select(text("position").alias("position"), text("hand").alias("hand"), text("family").alias("family"), F.length(text("family")).alias("fl"), F.length(text("given")).alias("gl"))
    cube = _cube(plain.groupBy("position", "hand", "family", "fl", "gl").agg(F.count("*").alias("n")))
    q = narrowed(queries, roster, least_position, least_hand, least_lengths)
    met = q.join(cube, F.col("position").eqNullSafe(F.col("p")) & F.col("hand").eqNullSafe(F.col("h")))
    near = lambda a, b: F.col(b).isNull() | (F.abs(F.col(a) - F.col(b)) <= 1)
    met = met.filter((F.col("families").isNull() | F.array_contains("families", F.col("family"))) & near("fl", "family_length") & near("gl", "given_length"))
    return met.select("query_id", *FLAGS, "position", "hand", "family", F.col("fl").alias("family_length"), F.col("gl").alias("given_length"), "pool")


def pool_members(cells: DataFrame, roster: DataFrame) -> DataFrame:
    """The records of the roster in each query's cells: query_id, the flags, pool, and the record's own columns."""
    held = roster.withColumns({"_f": F.coalesce("family", F.lit("")), "_g": F.length(F.coalesce("given", F.lit("")))})
    cells = cells.withColumnsRenamed({"position": "_cp", "hand": "_ch", "family": "_cf", "given_length": "_cg"}).drop("family_length")
    fits = (F.col("_f") == F.col("_cf")) & (F.col("_g") == F.col("_cg")) & (F.col("_cp").isNull() | (F.col("_cp") == F.col("position"))) & (F.col("_ch").isNull() | (F.col("_ch") == F.col("hand")))
    return cells.join(held, fits).drop("_cp", "_ch", "_cf", "_cg", "_f", "_g")
