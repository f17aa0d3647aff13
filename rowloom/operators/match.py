"""Matching noisy rows against a reference roster: scoring, margins, acceptance, consensus and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.text import name_similarity
from rowloom.operators.gates import narrowed
from rowloom.operators.names import best_named
from rowloom.operators.written import written

#: Runner-up score where there is none.
NONE = -9.0


def in_blocks(queries: DataFrame, rows: DataFrame, score: Column, query_block: int = 2_000, row_block: int = 20_000, top: int = 5, query: str = "query_id", row: str = "uid", tie: str = "uid") -> DataFrame:
    """The ``top`` rows of each query by score, best first, with their ``place``.

    A stated query set against all rows: both are cut into blocks of a counted size by hash, and
    each block of queries meets each block of rows in one task, where pairs are scored as they
    are made. The limit on places is applied below the shuffle, so only ``top`` rows of a query
    leave a task, and those partial tops are merged. ``score`` uses the columns of both sides.
    """
    asked, held = max(1, -(-queries.count() // query_block)), max(1, -(-rows.count() // row_block))
    q = queries.withColumn("_q", F.pmod(F.xxhash64(query), F.lit(asked)).cast("int")).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(held - 1))))
    r = rows.withColumn("_rr", F.pmod(F.xxhash64(row), F.lit(held)).cast("int")).withColumn("_rq", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))))
    pairs = q.join(r, (F.col("_q") == F.col("_rq")) & (F.col("_r") == F.col("_rr"))).drop("_q", "_r", "_rq", "_rr").withColumn("score", score)
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(tie))
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def with_margin(candidates: DataFrame, query: str = "query_id", none: float = NONE) -> DataFrame:
    """``margin``: what the best candidate is ahead of the second by, on every candidate of the query."""
    whole = Window.partitionBy(query)
    first = F.max(F.when(F.col("place") == 1, F.col("score"))).over(whole)
    second = F.max(F.when(F.col("place") == 2, F.col("score"))).over(whole)
    return candidates.withColumn("margin", first - F.coalesce(second, F.lit(none)))


def refine(candidates: DataFrame, again: int = 14) -> DataFrame:
    """Each query's best after a bounded refinement: query_id, uid, score, refined, refined_uid.

    candidates: query_id, uid, place, coarse and fine score. A query is refined unless its best
    stands out (from 0.60, ahead by 0.14) or is below 0.35. Then the first ``again`` candidates
    gain 0.38 of what their fine score is above the coarse one, 0.065 at most, and are ranked anew: a weak
    candidate can't become a strong one. refined_uid is the best by fine score alone. Ties go to the smaller uid.
    """
    whole = Window.partitionBy("query_id")
    first, second = (F.max(F.when(F.col("place") == n, F.col("coarse"))).over(whole) for n in (1, 2))
    strong = (F.col("_top") >= 0.60) & (F.round(F.col("_top") - F.coalesce("_second", F.lit(NONE)), 6) >= 0.14)
    rows = candidates.withColumns({"_top": first, "_second": second}).withColumn("refined", (F.col("_top") >= 0.35) & ~strong)
    gain = F.greatest(F.lit(0.0), F.least(F.lit(0.065), (F.col("fine") - F.col("coarse")) * 0.38))
    rows = rows.withColumn("score", F.when(F.col("refined") & (F.col("place") <= again), F.round(F.col("coarse") + gain, 6)).otherwise(F.col("coarse")))
    best = F.max_by(F.struct("uid", "score"), F.struct(F.col("score"), -F.col("uid")))
    return rows.groupBy("query_id").agg(best.alias("b"), F.first("refined").alias("refined"), F.max_by("uid", F.struct(F.col("fine"), -F.col("uid"))).alias("refined_uid")).select("query_id", "b.*", "refined", "refined_uid")


def name_counts(rows: DataFrame, name: str) -> DataFrame:
    """How many records hold each name: name, same_name."""
    return rows.groupBy(name).agg(F.count("*").alias("same_name"))


#: Least score, margin and visual score by mode (fixed values).
ACCEPT = {"flat": (0.78, 0.22, 0.75), "recovery": (0.73, 0.18, 0.69), "strong": (0.60, 0.14, None), "plain": (0.65, 0.15, 0.55)}


def accept(score: Column, margin: Column, visual: Column, same_name: Column, mode: Column) -> Column:
    """Whether a best candidate is a match: unique by name and over its mode's limits; other modes count as plain."""

    def passed(limits: tuple) -> Column:
        test = (score >= limits[0]) & (margin >= limits[1])
        return test if limits[2] is None else test & (visual >= limits[2])

    rule = F.when(mode == "flat", passed(ACCEPT["flat"])).when(mode == "recovery", passed(ACCEPT["recovery"])).when(mode == "strong", passed(ACCEPT["strong"])).otherwise(passed(ACCEPT["plain"]))
    return F.coalesce((same_name == 1) & rule, F.lit(False))


def fits_category(category: Column, position: Column) -> Column:
    """Whether a screen category allows a roster position; unknown categories allow none."""
    infield = position.isin("一壘手", "二壘手", "三壘手", "游擊手")
    return F.when(category == "內野手", infield).when(category.isin("投手", "捕手", "外野手"), position == category).otherwise(False)


def tentative(score: Column, second: Column, visual: Column, same_name: Column, category: Column, fits: Column) -> Column:
    """Whether a best candidate may be shown as tentative: a second exists, the name is unique, a given category fits, and one rule holds."""
    gap = score - second
    looks = F.coalesce(visual, score)
    given = F.coalesce(category, F.lit("")) != ""
    plain = (score >= 0.57) & (gap >= 0.075) & (looks >= 0.52)
    backed = given & fits & (score >= 0.55) & (gap >= 0.048) & (looks >= 0.50)
    clear = (score >= 0.65) & (gap >= 0.035) & (looks >= 0.59)
    return F.coalesce(second.isNotNull() & (same_name == 1) & (~given | fits) & (plain | backed | clear), F.lit(False))


def reconcile(p: Column, a: Column, same_name: Column) -> Column:
    """Which of two crops of a row to trust: primary, alternate, or promoted (the primary's best becomes a match).

    p and a: structs of uid, score, margin and matched, of the best candidate; null uid for none.
    """
    agree = p["uid"] == a["uid"]
    both = (p["score"] >= 0.67) & (a["score"] >= 0.67) & (F.coalesce(p["margin"], F.lit(0.0)) >= 0.10) & (F.coalesce(a["margin"], F.lit(0.0)) >= 0.10) & (same_name == 1)
    return (
        F.when(a["uid"].isNull(), "primary")
        .when(p["uid"].isNull(), "alternate")
        .when(p["matched"] | ~agree, "primary")
        .when(a["matched"] & (a["score"] >= p["score"] - 0.04), "alternate")
        .when(both, "promoted")
        .otherwise("primary")
    )


def corroborate(base: Column, a: Column, b: Column, same_name: Column, independent: Column) -> Column:
    """What two separator-free crops add to a row: confirmed, candidate or unchanged.

    base: struct of score and matched; a and b: structs of uid, score and matched.
    """
    agree = F.coalesce((a["uid"] == b["uid"]) & (same_name == 1), F.lit(False))
    open_row = ~F.coalesce(base["matched"], F.lit(False))
    confirmed = independent & a["matched"] & b["matched"] & (F.abs(a["score"] - b["score"]) <= 0.12)
    least = F.least(a["score"], b["score"])
    listed = (least >= 0.66) & (F.coalesce(base["score"], F.lit(NONE)) < least - 0.06)
    return F.when(agree & open_row & confirmed, "confirmed").when(agree & open_row & listed, "candidate").otherwise("unchanged")


def consensus(candidates: DataFrame, same_names: DataFrame, top: int = 5) -> DataFrame:
    """Per row the pooled best over its attempts and what follows: row, uid, score, gap, votes, attempts, accepted, attempt, chosen_uid, chosen_score.

    candidates: row, attempt, place, uid, score, ``matched`` (whether the attempt's first candidate is a match). An attempt that lacks a candidate
    counts for it 0.12 below its own last one. Accepted: three attempts or more, the best of them (of equals the earliest) no
    match, votes of three quarters of them (three at least), score from 0.66, gap from 0.145 and
    a unique name (same_names: uid, same_name). Where that holds, the pooled best is chosen, with the best
    attempt that has it first; else the best attempt, which may be a match. A match in a lesser attempt blocks nothing. Sums over attempts replace the cross of
    attempts with candidates: the pooled score is the sum of what is there plus the sum of all
    attempts' stand-ins less those of the attempts that have the candidate.
    """
    first = candidates.filter(F.col("place") <= top)
    lead = F.min_by(F.struct("score", "uid", F.coalesce("matched", F.lit(False)).alias("matched")), "place")
    attempts = candidates.groupBy("row", "attempt").agg((F.min_by("score", -F.col("place")) - 0.12).alias("stand_in"), lead.alias("lead"))
    order = F.struct(F.col("lead.score"), -F.col("attempt"))
    totals = attempts.groupBy("row").agg(F.sum("stand_in").alias("all_stand_in"), F.count("*").alias("attempts"), F.max_by(F.struct("attempt", "lead"), order).alias("best"))
    known = first.select("row", "uid").distinct().withColumnsRenamed({"row": "_r", "uid": "_u"})
    full = candidates.join(known, (F.col("row") == F.col("_r")) & (F.col("uid") == F.col("_u"))).drop("_r", "_u")
    full = full.join(attempts.select(F.col("row").alias("_r"), F.col("attempt").alias("_a"), "stand_in"), (F.col("row") == F.col("_r")) & (F.col("attempt") == F.col("_a")))
    supporting = F.max_by("attempt", F.when(F.col("place") == 1, F.struct(F.col("score"), -F.col("attempt"))))
    pooled = full.groupBy("row", "uid").agg(F.sum(F.col("score") - F.col("stand_in")).alias("above"), F.count_if(F.col("place") == 1).alias("votes"), supporting.alias("supporting"))
    pooled = pooled.join(totals, "row").withColumn("score", F.round((F.col("above") + F.col("all_stand_in")) / F.col("attempts"), 8))
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "uid")
    ranked = pooled.withColumns({"n": F.row_number().over(best), "gap": F.col("score") - F.coalesce(F.lead("score").over(best), F.lit(NONE))}).filter("n = 1")
    ranked = ranked.join(same_names, "uid", "left")
    enough = F.col("votes") >= F.greatest(F.lit(3), F.ceil(F.col("attempts") * 0.75))
    accepted = (F.col("attempts") >= 3) & ~F.col("best.lead.matched") & enough & (F.col("score") >= 0.66) & (F.round("gap", 8) >= 0.145) & (F.col("same_name") == 1)
    ranked = ranked.withColumn("accepted", F.coalesce(accepted, F.lit(False)))
    of = lambda yes, no: F.when(F.col("accepted"), F.col(yes)).otherwise(F.col(no))
    return ranked.select("row", "uid", "score", "gap", "votes", "attempts", "accepted", of("supporting", "best.attempt").alias("attempt"), of("uid", "best.lead.uid").alias("chosen_uid"), of("score", "best.lead.score").alias("chosen_score"))


def gated_pool(queries: DataFrame, rows: DataFrame, gate: str, least: int = 10) -> DataFrame:
    """Queries with their gate, or null where ``least`` or fewer rows would remain and the whole roster serves."""
    sizes = rows.groupBy(F.col(gate).alias("_g")).agg(F.count("*").alias("pool"))
    joined = queries.join(sizes, F.col(gate) == F.col("_g"), "left").withColumn("pool", F.coalesce("pool", F.lit(0)))
    return joined.withColumn("gate", F.when(F.col("pool") > least, F.col(gate))).drop("_g")


def _chars(key: Column) -> Column:
    return F.filter(F.split(key, ""), lambda c: c != "")


def letter_set(key: Column) -> Column:
    """The different characters of a key."""
    return F.array_distinct(_chars(key))


def letter_bag(key: Column) -> Column:
    """The characters of a key with the number of their occurrence, so that shared elements count repeats."""
    letters = _chars(key)
    return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def rare_first(bags: DataFrame, bag: str) -> DataFrame:
    """``bags`` with the elements of ``bag``, which tells rows apart, put in one order for all: rare ones first, by how many bags hold them."""
    cells = bags.select(bag, F.explode(bag).alias("_e"))
    counts = cells.groupBy("_e").agg(F.count("*").alias("_n"))  # a row for each element of the alphabet
    put = cells.join(counts, "_e").groupBy(bag).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_e"))), lambda x: x["_e"]).alias("_put"))
    return bags.join(put, bag).drop(bag).withColumnRenamed("_put", bag)


def sharing_bags(bags: DataFrame, share: float, bound, together: int = 4) -> DataFrame:
    """Pairs of bags whose ``bound`` passes: bag_a, bag_b, common (number of shared elements).

    bags: one column ``bag``, an array of elements in one order for all; ``bound(common, size_a, size_b)`` has to imply
    that the shared elements are at least ``share`` of either size. Two bags that share c elements of n
    have ``together`` of them among the first n - c + together, so bags meet on
    combinations of so many of their first elements (prefix filter), rare ones as these stand first. A pair is made at its first
    common combination only, and passes the bound inside the join, so none is made twice. Bags too small to
    owe that many shared elements meet on single ones among themselves.
    """
    size, need = F.size("bag"), F.ceil(F.size("bag") * share - 1e-9).cast("int")
    first = F.slice("bag", F.lit(1), F.least(size, size - F.greatest(need, F.lit(together)) + together))
    combos = F.transform(first, lambda e: F.array(e))
    for _ in range(together - 1):
        combos = F.flatten(F.transform(combos, lambda c: F.transform(F.slice(first, F.array_position(first, F.element_at(c, -1)).cast("int") + 1, F.size(first)), lambda e: F.array_append(c, e))))
    large = bags.filter(size >= together).select("bag", F.explode(combos).alias("combo"))
    few = bags.filter(need < together).select("bag", F.explode(F.transform(F.slice("bag", F.lit(1), size - need + 1), lambda e: F.array(e))).alias("combo"))

    def met(side: DataFrame, n: int) -> DataFrame:
        a, b = side.alias("a"), side.alias("b")
        shared = F.array_intersect(F.col("a.bag"), F.col("b.bag"))
        same = (F.col("a.combo") == F.col("b.combo")) & (F.col("a.bag") < F.col("b.bag"))
        near = F.least(F.size("a.bag"), F.size("b.bag")) >= F.greatest(F.size("a.bag"), F.size("b.bag")) * share - 1e-9
        owes = bound(F.size(shared), F.size("a.bag"), F.size("b.bag"))
        pairs = a.join(b, same & near & owes & (F.slice(shared, 1, n) == F.col("a.combo")))
        return pairs.select(F.col("a.bag").alias("bag_a"), F.col("b.bag").alias("bag_b"), F.size(shared).alias("common"))

    found = met(large, together)
    return found.unionByName(met(few, 1).filter(F.col("common") < together)) if together > 1 else found


def _in_order(keys: DataFrame) -> DataFrame:
    """name_key with its bag in the order of rare_first(), written once; keys: name_key and a sorted bag."""
    keys = written(keys, "name-bags")
    ordered = rare_first(keys.select("bag").distinct().withColumn("sorted", F.col("bag")), "bag")
    return written(keys.join(ordered.withColumnRenamed("bag", "put"), F.col("bag") == F.col("sorted")).select("name_key", F.col("put").alias("bag")), "ordered-bags")


def alike_names(names: DataFrame, key: Column, least: float = 0.7) -> DataFrame:
    """Every pair of different name keys, once, whose name_similarity() is ``least`` (0.7 or more) or more: name_a, name_b, similarity.

    With c characters in common, repeats counted, the edit distance is at least the longer
    length less c, which bounds the similarity; at 0.7 it makes c 0.66 of either length at least.
    """
    if least < 0.7:
        raise ValueError("shared characters bound similarities from 0.7 on")
    keys = names.select(key.alias("name_key")).filter("name_key <> ''").distinct().withColumn("bag", F.array_sort(letter_bag(F.col("name_key"))))
    of = _in_order(keys)

    def bound(c: Column, a: Column, b: Column) -> Column:
        return c / F.greatest(a, b) * 0.72 + 2 * c / (a + b) * 0.28 >= least - 1e-9

    return _named_pairs(of, sharing_bags(of.select("bag").distinct(), 0.66, bound), lambda a, b, _: name_similarity(a, b), least)


def dice_names(names: DataFrame, key: Column, least: float = 0.8) -> DataFrame:
    """Every pair of different name keys, once, whose character sets have a Dice coefficient of ``least`` or more: name_a, name_b, similarity."""
    keys = names.select(key.alias("name_key")).filter("name_key <> ''").distinct().withColumn("bag", F.array_sort(letter_set(F.col("name_key"))))
    of = _in_order(keys)
    dice = lambda c, a, b: 2.0 * c / (a + b)
    # of two sets of a coefficient d, c is d / (2 - d) of the larger one at least
    pairs = sharing_bags(of.select("bag").distinct(), least / (2 - least), lambda c, a, b: dice(c, a, b) >= least)
    return _named_pairs(of, pairs, lambda a, b, row: dice(row["common"], F.size(row["bag_a"]), F.size(row["bag_b"])), least)


def _named_pairs(of: DataFrame, pairs: DataFrame, similarity, least: float) -> DataFrame:
    """Names of equal bags, and names of the bags of each pair, that pass: name_a, name_b, similarity."""
    same = of.select("bag", "bag", F.size("bag")).toDF("bag_a", "bag_b", "common").distinct()
    whole = pairs.unionByName(same)
    one, two = of.select(F.col("name_key").alias("x"), F.col("bag").alias("_a")), of.select(F.col("name_key").alias("y"), F.col("bag").alias("_b"))
    made = whole.join(one, F.col("bag_a") == F.col("_a")).join(two, (F.col("bag_b") == F.col("_b")) & ((F.col("bag_a") != F.col("bag_b")) | (F.col("x") < F.col("y"))))
    named = made.withColumns({"name_a": F.least("x", "y"), "name_b": F.greatest("x", "y")})
    row = {c: F.col(c) for c in ("common", "bag_a", "bag_b")}
    return named.select("name_a", "name_b", similarity(F.col("name_a"), F.col("name_b"), row).alias("similarity")).filter(F.col("similarity") >= least)


def text_score(name: Column, family: Column, given: Column, target: Column, target_family: Column, target_given: Column) -> Column:
    """Struct of ``full``, ``sur``, ``giv`` and ``name``: how a read name is like a roster's, whole or by its parts; keys on both sides."""
    full, sur, giv = name_similarity(name, target), name_similarity(family, target_family), name_similarity(given, target_given)
    has_sur, has_giv = family != "", given != ""
    weight = F.when(has_sur, 0.54).otherwise(0.0) + F.when(has_giv, 0.46).otherwise(0.0)
    sur, giv = F.when(has_sur, sur).otherwise(0.0), F.when(has_giv, giv).otherwise(0.0)
    part = (sur * 0.54 + giv * 0.46) / F.when(weight > 0, weight).otherwise(1.0)
    return F.struct(full.alias("full"), sur.alias("sur"), giv.alias("giv"), F.greatest(full, part).alias("name"))


def text_total(like: Column, hand: Column, position: Column, age: Column, family_off: Column, given_off: Column) -> Column:
    """The score of a read name with what else agrees: booleans for hand, position and age, and for parts whose lengths are off by over one."""
    bonus = F.when(hand, 0.055).otherwise(0.0) + F.when(position, 0.04).otherwise(0.0) + F.when(age, 0.008).otherwise(0.0)
    return like["name"] * 0.88 + bonus - F.when(family_off, 0.06).otherwise(0.0) - F.when(given_off, 0.06).otherwise(0.0)


def text_accept(like: Column, meta: Column, margin: Column, both_parts: Column) -> Column:
    """Whether the best candidate of a read name is a match; meta: how many of hand and position agree."""
    split = both_parts & (like["sur"] >= 0.72) & (like["giv"] >= 0.64) & (margin >= 0.02)
    name = like["name"]
    return ((name >= 0.90) & (margin >= 0.018)) | split | ((name >= 0.74) & (meta >= 1) & (margin >= 0.025)) | ((name >= 0.68) & (meta >= 2) & (margin >= 0.02))


def evidence_matches(evidence: DataFrame, roster: DataFrame) -> DataFrame:
    """The best record for each key of tiers.as_evidence(): key, uid, score; keys without any name have none.

    Position and hand narrow the roster where something remains; of several readings of a name
    the one most like the record counts. roster: uid, family, given, position, hand, age. Ties go to the smaller uid.
    """
    asked = evidence.filter(F.size("names") > 0)
    # only position and hand narrow: each different pair of them is gated once
    gates = asked.select("position", "hand").distinct().select(F.struct("position", "hand").alias("query_id"), "position", "hand", F.lit("").alias("family"), F.lit(None).cast("int").alias("family_length"), F.lit(None).cast("int").alias("given_length"))
    taken = narrowed(gates, roster).select(F.col("query_id").alias("_q"), "position", "hand", F.col("families").alias("short"), "family_length", "given_length")
    read = asked.select("key", "names", "families", "givens", *[F.col(c).alias(f"r_{c}") for c in ("family", "given", "position", "hand", "age")])
    same = (F.col("r_position") == F.col("_q.position")) & (F.col("r_hand") == F.col("_q.hand"))
    return best_named(read.join(taken, same).drop("_q"), roster, "key").select("key", "uid", "score")
