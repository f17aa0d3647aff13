"""Queries that resolve rows in several steps: votes over attempts, a cascade of searches, unique assignment, planned overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import numbers
from rowloom.operators import agreement, assign, match, stitch, vectors
from rowloom.operators.cascade import Stage, item, run_cascade, stage_sizes
from rowloom.plans.matching import event_pages
from rowloom.plans.registry import query
from rowloom.plans.search import table

# ---- readings of rows


def crop_weight(n, crop):
    """How much of another row stands in a crop of the n-th row."""
    return F.pmod(n * 7 + crop * 5, F.lit(11)) / 16


READINGS_SQL = """
r0 AS (SELECT vec_id, label, CASE WHEN vec_id % 60 = 0 THEN vec_id + 1 ELSE vec_id END AS name, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
r1 AS (SELECT *, list_transform(e, lambda x: x - list_sum(e) / 64) AS m FROM r0),
rows AS (SELECT vec_id AS uid, label, name, e, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m) + 1e-8)) AS u FROM r1),
names AS (SELECT uid, count(*) OVER (PARTITION BY name) AS same_name FROM rows),
asked AS (SELECT uid AS row, uid // 20 AS n, CASE WHEN uid // 20 % 4 = 0 THEN NULL WHEN uid // 20 % 5 = 0 THEN (label + 1) % 10 ELSE label END AS category, e FROM rows WHERE uid % 20 = 0),
w0 AS (SELECT a.row, a.category, crop, list_transform(generate_series(1, 64), lambda i: a.e[i] * (1 - (n * 7 + crop * 5) % 11 / 16.0::DOUBLE) + o.e[i] * ((n * 7 + crop * 5) % 11 / 16.0::DOUBLE)) AS v
       FROM asked a, (SELECT unnest(generate_series(0, 9)) AS crop) JOIN rows o ON o.uid = a.row + 1 + crop),
w1 AS (SELECT *, list_transform(v, lambda x: x - list_sum(v) / 64) AS m FROM w0),
w AS (SELECT row, category, crop, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m) + 1e-8)) AS q FROM w1),
s0 AS (SELECT w.row, crop, gated, uid, round(list_inner_product(q, u), 6) AS score FROM w, rows, (SELECT unnest([false, true]) AS gated) WHERE NOT gated OR category IS NULL OR label = category),
s1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY row, crop, gated ORDER BY score DESC, uid) AS INTEGER) AS place FROM s0 QUALIFY place <= 5),
s AS (SELECT *, round(max(CASE WHEN place = 1 THEN score END) OVER p - coalesce(max(CASE WHEN place = 2 THEN score END) OVER p, -9.0::DOUBLE), 6) AS margin FROM s1 WINDOW p AS (PARTITION BY row, crop, gated)),
t AS (SELECT s.*, same_name, same_name = 1 AND score >= 0.60 AND margin >= 0.14 AS matched, same_name = 1 AND score >= 0.73 AND margin >= 0.18 AS recovered, same_name = 1 AND score >= 0.78 AND margin >= 0.22 AS flat FROM s JOIN names USING (uid))"""


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as records: uid, label, name (some share one), e, its unit vector u, same_name."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    name = F.when(F.col("vec_id") % 60 == 0, F.col("vec_id") + 1).otherwise(F.col("vec_id"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), "label", name.alias("name"), e.alias("e"), numbers.centred(F.col("embedding")).alias("u"))
    return rows.join(match.name_counts(rows, "name"), "name")


def readings(rows: DataFrame) -> DataFrame:
    """Ten crops of every record whose id divides by 20, each mixed with a neighbour: row, category, crop, q.

    category: the label, a wrong one or, for every fourth row, null.
    """
    n = F.floor(F.col("uid") / 20)
    category = F.when(n % 4 == 0, F.lit(None)).when(n % 5 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    asked = rows.filter("uid % 20 = 0").select(F.col("uid").alias("row"), n.alias("n"), category.alias("category"), "e").withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(9))))
    other = rows.select(F.col("uid").alias("_o"), F.col("e").alias("o"))
    mixed = asked.join(other, F.col("_o") == F.col("row") + 1 + F.col("crop")).withColumn("w", crop_weight(F.col("n"), F.col("crop")))
    v = numbers.let(F.col("w"), lambda w: F.zip_with("e", "o", lambda a, b: a * (1 - w) + b * w))
    return mixed.select("row", "category", "crop", numbers.centred(v).alias("q"))


def search_crops(crops: DataFrame, rows: DataFrame, gated: bool, top: int = 5) -> DataFrame:
    """The best records of every crop (row, category, crop, q), of its category alone where ``gated``: row, attempt, place, uid, score, margin, same_name."""
    asked = crops.withColumn("query_id", F.col("row") * 16 + F.col("crop"))
    found = vectors.best_by_product(asked, rows.select("uid", "label", "u", "same_name"), ("q", "u"), top=top, gate=("category", "label") if gated else None).filter("score is not null")
    found = match.with_margin(found).withColumn("margin", F.round("margin", 6))
    return found.select("row", F.col("crop").cast("int").alias("attempt"), "place", "uid", "score", "margin", "same_name")


def accepted(mode: str):
    return match.accept(F.col("score"), F.col("margin"), F.col("score"), F.col("same_name"), F.lit(mode))


def aligned_items(found: DataFrame, names: DataFrame) -> DataFrame:
    """One item for each row from its attempts: the attempt to trust, else what they vote for, else the best; row, found."""
    found = found.withColumn("matched", accepted("strong"))
    picked = agreement.pick_attempt(found.filter("place = 1").withColumn("step", F.col("attempt")))
    voted = match.consensus(found.select("row", "attempt", "place", "uid", "score", "matched"), names).filter("accepted")
    voted = voted.select(F.col("row").alias("_v"), F.struct(F.col("uid").alias("uid"), "score", F.round("gap", 8).alias("gap"), "attempt").alias("v"))
    both = picked.join(voted, F.col("row") == F.col("_v"), "left")
    vote = F.col("v").isNotNull() & (F.col("rule") == "best")
    of = lambda a, b: F.when(vote, a).otherwise(b)
    chosen = item(of(F.col("v.uid"), F.col("uid")), of(F.col("v.score"), F.col("score")), of(F.col("v.gap"), F.col("margin")), of(F.lit(True), F.col("matched")), of(F.col("v.attempt"), F.col("step")), of(F.lit("consensus"), F.col("rule")))
    return both.select("row", chosen.alias("found"))


ALIGNED_SQL = """
a AS (SELECT row, crop, uid, score, margin, matched FROM t WHERE place = 1 AND gated AND crop < 4),
ab AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, crop) = 1),
ac AS (SELECT * FROM a WHERE matched QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, crop) = 1),
af AS (SELECT * FROM a WHERE crop = 0 AND matched AND score >= 0.70 AND margin >= 0.18),
ai AS (SELECT row, min(score) - 0.12 AS stand_in, crop FROM t WHERE gated AND crop < 4 GROUP BY row, crop),
au AS (SELECT row, uid, count(*) FILTER (WHERE place = 1) AS votes, arg_max(crop, score - crop * 1e-9) FILTER (WHERE place = 1) AS crop FROM t WHERE gated AND crop < 4 GROUP BY ALL),
am AS (SELECT au.row, au.uid, any_value(votes) AS votes, any_value(au.crop) AS crop, count(*) AS attempts, round(avg(coalesce(t.score, stand_in)), 8) AS score FROM au JOIN ai USING (row) LEFT JOIN t ON t.gated AND t.row = au.row AND t.crop = ai.crop AND t.uid = au.uid GROUP BY au.row, au.uid),
av AS (SELECT *, round(score - coalesce(lead(score) OVER z, -9), 8) AS gap, row_number() OVER z AS k FROM am WINDOW z AS (PARTITION BY row ORDER BY score DESC, uid)),
aw AS (SELECT av.* FROM av JOIN names USING (uid) JOIN ab ON ab.row = av.row WHERE k = 1 AND attempts >= 3 AND votes >= greatest(3, ceil(attempts * 0.75)) AND av.score >= 0.66 AND gap >= 0.145 AND same_name = 1 AND NOT ab.matched),
i1 AS (SELECT ab.row, CASE WHEN af.row IS NOT NULL THEN af WHEN NOT ab.matched AND ac.score >= ab.score - 0.055 AND ac.uid = ab.uid THEN ac ELSE ab END AS pick,
              CASE WHEN af.row IS NOT NULL THEN 'first' WHEN NOT ab.matched AND ac.score >= ab.score - 0.055 AND ac.uid = ab.uid THEN 'confirmed' ELSE 'best' END AS rule FROM ab LEFT JOIN ac USING (row) LEFT JOIN af USING (row)),
al AS (SELECT i1.row, CASE WHEN rule = 'best' AND aw.row IS NOT NULL THEN {'uid': aw.uid, 'score': aw.score, 'margin': aw.gap, 'matched': true, 'crop': aw.crop, 'method': 'consensus'}
         ELSE {'uid': pick.uid, 'score': pick.score, 'margin': pick.margin, 'matched': pick.matched, 'crop': pick.crop, 'method': rule} END AS i FROM i1 LEFT JOIN aw ON aw.row = i1.row)"""


@query("attempt_vote", f"WITH {READINGS_SQL}, {ALIGNED_SQL} SELECT row, CAST(i.crop AS INTEGER) AS crop, i.uid, i.score, i.margin, i.matched, i.method FROM al")
def attempt_vote(spark, sf_dir):
    """Four crops of each row: the attempt to trust, then the vote where none stands out."""
    rows = roster(spark, sf_dir)
    found = search_crops(readings(rows).filter("crop < 4"), rows, gated=True)
    return aligned_items(found, rows.select("uid", "same_name")).select("row", "found.*")


# ---- the cascade


def _first(found: DataFrame, mode: str):
    """The best candidate of each row's only crop as ``found``, an item without method."""
    best = found.filter("place = 1")
    return best.select("row", F.struct("uid", "score", "margin", accepted(mode).alias("matched"), F.col("attempt").alias("crop"), "same_name").alias("found"))


def _two_crops(found: DataFrame, first: int):
    """The best candidates of two crops of each row side by side, and the row's unique-name flag of the first."""
    best = found.filter("place = 1").withColumn("b", F.struct("uid", "score", "margin", accepted("flat").alias("matched"), F.col("attempt").alias("crop"), "same_name"))
    of = lambda test: F.max(F.when(test, F.col("b")))
    per = best.groupBy("row").agg(of(F.col("attempt") == first).alias("a"), of(F.col("attempt") != first).alias("b"))
    return per.select("row", F.struct("a", "b").alias("found"))


def cascade_stages(spark: SparkSession, sf_dir: str) -> list[Stage]:
    """Pool search by four aligned crops, a retry in the whole roster, the original crop, a second crop, a recovery, other copies, two flat crops."""
    rows = roster(spark, sf_dir)
    crops = readings(rows)
    i, f = F.col("item"), F.col("found")
    n = F.floor(F.col("row") / 20)

    def of(open_rows: DataFrame, crop) -> DataFrame:
        """The given crops (a column of the row or an array of them) of open rows."""
        taken = open_rows.select(F.col("row").alias("_row"), F.explode(F.array_distinct(crop)).alias("_crop"))
        return crops.join(taken, (F.col("row") == F.col("_row")) & (F.col("crop") == F.col("_crop"))).select(crops.columns)

    def kept(test, new, method):
        """``found`` under a method's name where the test holds, else the item as it was."""
        return F.when(F.coalesce(test, F.lit(False)), item(new["uid"], new["score"], new["margin"], new["matched"], new["crop"], F.lit(method))).otherwise(i)

    two = search_crops
    unmatched = ~F.coalesce(i["matched"], F.lit(False))
    category = F.when(n % 4 != 0, "given").otherwise("")
    trusted = match.reconcile(i, f, f["same_name"])
    promoted = item(i["uid"], i["score"], i["margin"], F.lit(True), i["crop"], F.lit("promoted"))
    flat = match.corroborate(i, f["a"], f["b"], f["a"]["same_name"], F.lit(True))
    stronger = F.when(f["a"]["score"] >= f["b"]["score"], f["a"]).otherwise(f["b"])
    listed = item(f["a"]["uid"], F.least(f["a"]["score"], f["b"]["score"]), f["a"]["margin"], F.lit(False), f["a"]["crop"], F.lit("listed"))

    def copies(open_rows: DataFrame) -> DataFrame:
        found = two(of(open_rows, F.when(n % 3 == 2, F.array(F.lit(6), F.lit(7))).otherwise(F.array(F.lit(6)))), rows, gated=True, top=2)
        one = _first(found, "strong")
        return one.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("found.crop").alias("order"), "found"))).alias("found"))

    as_item = lambda c, method: item(c["uid"], c["score"], c["margin"], c["matched"], c["crop"], method)
    folded = F.reduce(f, i, lambda now, c: F.when(agreement.copy_wins(now, c["found"]), as_item(c["found"], F.lit("copy"))).otherwise(now))
    return [
        Stage("aligned", n % 7 != 0, lambda o: aligned_items(two(of(o, F.array(*map(F.lit, range(4)))), rows, gated=True), rows.select("uid", "same_name")), f),
        Stage("retry", i.isNotNull() & agreement.needs_retry(category, i["matched"], i["margin"], i["score"]), lambda o: _first(two(of(o, F.array("item.crop")), rows, gated=False, top=2), "strong"), kept(agreement.retry_wins(i["score"], i["matched"], f["score"], f["matched"]), f, "retry")),
        Stage("original", i.isNull(), lambda o: _first(two(of(o, F.array(F.lit(4))), rows, gated=False, top=2), "strong"), kept(f.isNotNull(), f, "original")),
        Stage("second crop", i.isNotNull() & unmatched, lambda o: _first(two(of(o, F.array(F.lit(4))), rows, gated=False, top=2), "strong"), F.when(trusted == "promoted", promoted).otherwise(kept(trusted == "alternate", f, "alternate"))),
        Stage("recovery", i.isNotNull() & unmatched & (i["score"] >= 0.4), lambda o: _first(two(of(o, F.array(F.lit(5))), rows, gated=False, top=2), "recovery"), kept(f["matched"] & (f["uid"] == i["uid"]) & (f["score"] >= i["score"] - 0.04), f, "recovery")),
        Stage("copies", (n % 3 > 0) & (unmatched | (i["score"] < 0.65)), copies, F.when(f.isNotNull(), folded).otherwise(i)),
        Stage("flat", i.isNotNull() & unmatched, lambda o: _two_crops(two(of(o, F.array(F.lit(8), F.lit(9))), rows, gated=False, top=2), 8), F.when(flat == "candidate", listed).otherwise(kept(flat == "confirmed", stronger, "flat"))),
    ]


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("row"))
    return run_cascade(asked, cascade_stages(spark, sf_dir))


def _found_sql(crop: str, gated: str = "false", flag: str = "matched") -> str:
    return f"SELECT row AS fr, {{'uid': uid, 'score': score, 'margin': margin, 'matched': {flag}, 'crop': crop, 'method': ''}} AS f, same_name AS fs FROM t WHERE place = 1 AND gated = {gated} AND {crop}"


def _as(c: str, method: str) -> str:
    return f"{{'uid': {c}.uid, 'score': {c}.score, 'margin': {c}.margin, 'matched': {c}.matched, 'crop': {c}.crop, 'method': '{method}'}}"


def _wins(p: str, o: str) -> str:
    return f"coalesce({o}.uid IS NOT NULL AND ({p}.uid IS NULL OR {o}.score > {p}.score + 0.055 OR ({o}.matched AND NOT {p}.matched AND {p}.uid = {o}.uid AND {o}.score >= {p}.score - 0.055)), false)"


CASCADE_SQL = f"""
WITH {READINGS_SQL}, {ALIGNED_SQL},
k1 AS (SELECT a.row, n, n % 7 <> 0 AS o1, CASE WHEN n % 7 <> 0 THEN al.i END AS i FROM asked a LEFT JOIN al ON al.row = a.row),
k2a AS (SELECT *, i IS NOT NULL AND n % 4 <> 0 AND (NOT i.matched OR i.margin < 0.16 OR i.score < 0.67) AS o2 FROM k1),
k2 AS (SELECT k.row, n, o1, o2, CASE WHEN o2 AND (f.score >= i.score + 0.02 OR (NOT i.matched AND f.matched)) THEN {_as("f", "retry")} ELSE i END AS i FROM k2a k LEFT JOIN ({_found_sql("true")}) ON fr = k.row AND f.crop = i.crop),
k3a AS (SELECT *, i IS NULL AS o3 FROM k2),
k3 AS (SELECT k.row, n, o1, o2, o3, CASE WHEN o3 THEN {_as("f", "original")} ELSE i END AS i FROM k3a k LEFT JOIN ({_found_sql("crop = 4")}) ON fr = k.row),
k4a AS (SELECT *, i IS NOT NULL AND NOT i.matched AS o4 FROM k3),
k4 AS (SELECT k.row, n, o1, o2, o3, o4, CASE WHEN o4 AND i.uid = f.uid AND f.matched AND f.score >= i.score - 0.04 THEN {_as("f", "alternate")}
   WHEN o4 AND i.uid = f.uid AND i.score >= 0.67 AND f.score >= 0.67 AND i.margin >= 0.10 AND f.margin >= 0.10 AND fs = 1 THEN {{'uid': i.uid, 'score': i.score, 'margin': i.margin, 'matched': true, 'crop': i.crop, 'method': 'promoted'}} ELSE i END AS i FROM k4a k LEFT JOIN ({_found_sql("crop = 4")}) ON fr = k.row),
k5a AS (SELECT *, i IS NOT NULL AND NOT i.matched AND i.score >= 0.4 AS o5 FROM k4),
k5 AS (SELECT k.row, n, o1, o2, o3, o4, o5, CASE WHEN o5 AND f.matched AND f.uid = i.uid AND f.score >= i.score - 0.04 THEN {_as("f", "recovery")} ELSE i END AS i FROM k5a k LEFT JOIN ({_found_sql("crop = 5", flag="recovered")}) ON fr = k.row),
k6a AS (SELECT *, n % 3 > 0 AND (NOT coalesce(i.matched, false) OR i.score < 0.65) AS o6 FROM k5),
k6b AS (SELECT k.*, CASE WHEN o6 AND {_wins("i", "f")} THEN {_as("f", "copy")} ELSE i END AS j FROM k6a k LEFT JOIN ({_found_sql("crop = 6", "true")}) ON fr = k.row),
k6 AS (SELECT k.row, n, o1, o2, o3, o4, o5, o6, CASE WHEN o6 AND n % 3 = 2 AND {_wins("j", "f")} THEN {_as("f", "copy")} ELSE j END AS i FROM k6b k LEFT JOIN ({_found_sql("crop = 7", "true")}) ON fr = k.row),
k7a AS (SELECT *, i IS NOT NULL AND NOT i.matched AS o7 FROM k6),
k7 AS (SELECT k.row, o1, o2, o3, o4, o5, o6, o7, CASE WHEN NOT o7 OR a.f.uid <> b.f.uid OR a.fs <> 1 THEN i WHEN a.f.matched AND b.f.matched AND abs(a.f.score - b.f.score) <= 0.12 THEN CASE WHEN a.f.score >= b.f.score THEN {_as("a.f", "flat")} ELSE {_as("b.f", "flat")} END
   WHEN least(a.f.score, b.f.score) >= 0.66 AND i.score < least(a.f.score, b.f.score) - 0.06 THEN {{'uid': a.f.uid, 'score': least(a.f.score, b.f.score), 'margin': a.f.margin, 'matched': false, 'crop': a.f.crop, 'method': 'listed'}} ELSE i END AS i
   FROM k7a k LEFT JOIN ({_found_sql("crop = 8", flag="flat")}) a ON a.fr = k.row LEFT JOIN ({_found_sql("crop = 9", flag="flat")}) b ON b.fr = k.row),
z AS (SELECT row, i.uid, i.score, i.margin, i.matched, CAST(i.crop AS INTEGER) AS crop, i.method, list_filter([CASE WHEN o1 THEN 'aligned' END, CASE WHEN o2 THEN 'retry' END, CASE WHEN o3 THEN 'original' END, CASE WHEN o4 THEN 'second crop' END, CASE WHEN o5 THEN 'recovery' END, CASE WHEN o6 THEN 'copies' END, CASE WHEN o7 THEN 'flat' END], lambda x: x IS NOT NULL) AS path FROM k7)
"""


@query("cascade_resolve", CASCADE_SQL + "SELECT row, uid, score, margin, matched, crop, method, array_to_string(path, ',') AS path FROM z")
def cascade_resolve(spark, sf_dir):
    """Each row's final reading, how it was found and the stages that scored it."""
    return cascade(spark, sf_dir).select("row", "item.*", F.array_join("path", ",").alias("path"))


@query("cascade_stage_sizes", CASCADE_SQL + "SELECT unnest(path) AS stage, count(*) AS n FROM z GROUP BY 1")
def cascade_stage_sizes(spark, sf_dir):
    """How many rows each stage of the cascade scored."""
    return stage_sizes(cascade(spark, sf_dir))


# ---- unique assignment


OFFERS_SQL = """
c0 AS (SELECT o_custkey AS grp, l_orderkey AS row, l_suppkey % 12 AS uid, round(0.5 + l_discount * 3.7 + l_tax / 3, 4) AS score, l_linenumber % 3 AS meta, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS agreed, l_linestatus = 'O' AND l_quantity > 25 AS read, l_quantity = 50 AND l_returnflag = 'A' AS used
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c1 AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY row, uid ORDER BY score DESC, meta DESC, agreed DESC, read DESC) = 1),
k AS (SELECT DISTINCT grp, uid FROM c0 WHERE used),
c AS (SELECT c1.* FROM c1 WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.grp = c1.grp AND k.uid = c1.uid))"""

ASSIGN_SQL = f"""
WITH RECURSIVE {OFFERS_SQL},
g AS (
  SELECT grp, []::BIGINT[] AS rows, []::BIGINT[] AS uids, []::DOUBLE[] AS scores FROM c GROUP BY grp
  UNION ALL
  SELECT grp, list_append(any_value(rows), first(row ORDER BY quality DESC, row)), list_append(any_value(uids), first(uid ORDER BY quality DESC, row)), list_append(any_value(scores), first(score ORDER BY quality DESC, row)) FROM (
    SELECT *, round(score + (score - next) * 0.45 + meta * 0.015, 9) AS quality, round(score - next, 9) AS gap FROM (
      SELECT grp, row, any_value(rows) AS rows, any_value(uids) AS uids, any_value(scores) AS scores, first(uid ORDER BY score DESC, uid) AS uid, first(meta ORDER BY score DESC, uid) AS meta, first(agreed ORDER BY score DESC, uid) AS agreed, first(read ORDER BY score DESC, uid) AS read,
        max(score) AS score, coalesce(list(score ORDER BY score DESC, uid)[2], 0) AS next
      FROM (SELECT c.*, g.rows, g.uids, g.scores FROM g JOIN c ON c.grp = g.grp WHERE NOT list_contains(g.rows, c.row) AND NOT list_contains(g.uids, c.uid)) GROUP BY grp, row))
  WHERE (score >= 0.72 AND gap >= 0.035) OR (score >= 0.67 AND meta >= 1 AND gap >= 0.04) OR (score >= 0.64 AND meta >= 2 AND gap >= 0.045) OR (meta >= 1 AND gap >= 0.025 AND ((agreed >= 2 AND score >= 0.62) OR (read AND score >= 0.66)))
  GROUP BY grp)
SELECT grp AS custkey, unnest(rows) AS row, unnest(uids) AS uid, unnest(scores) AS score FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY grp ORDER BY len(rows) DESC) = 1)
"""


@query("unique_assignment", ASSIGN_SQL)
def unique_assignment(spark, sf_dir):
    """Orders of a customer as rows, the suppliers' groups of their lines as candidates, each used once by customer."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_o"), F.col("o_custkey").alias("group"))
    score = F.round(0.5 + F.col("l_discount") * 3.7 + F.col("l_tax") / 3, 4)
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("_o"))
    offers = lines.select(
        "group",
        F.col("l_orderkey").alias("row"),
        (F.col("l_suppkey") % 12).alias("uid"),
        score.alias("score"),
        (F.col("l_linenumber") % 3).alias("meta"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("agreed"),
        ((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 25)).alias("read"),
        ((F.col("l_quantity") == 50) & (F.col("l_returnflag") == "A")).alias("used"),
    )
    best = offers.groupBy("group", "row", "uid").agg(F.max(F.struct("score", "meta", "agreed", "read")).alias("b")).select("group", "row", "uid", "b.*")
    found = assign.assign_unique(best, offers.filter("used").select("group", "uid"))
    return found.select(F.col("group").alias("custkey"), "row", "uid", "score")


# ---- planned overlaps


PLAN_SQL = """
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT *, CAST(greatest(0, floor((n - 12) / 7.0) + 1) AS BIGINT) AS lo, CAST(floor((n - 1) / 7.0) AS BIGINT) AS hi FROM e),
x AS (SELECT user_id, page, n - page * 7 AS row, event_id, event_type, value FROM (SELECT *, unnest(generate_series(lo, hi)) AS page FROM p)),
g AS (SELECT user_id, page, count(*) AS size, lead(count(*)) OVER (PARTITION BY user_id ORDER BY page) AS next FROM x GROUP BY user_id, page),
t AS (SELECT user_id, sum(size) AS size, CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN (SELECT count(*) FROM e WHERE e.user_id = g.user_id) // 3 ELSE (SELECT count(*) FROM e WHERE e.user_id = g.user_id) END AS total FROM g GROUP BY user_id),
need AS (SELECT user_id, CAST(CASE WHEN total > 0 THEN greatest(0, size - total) ELSE 0 END AS INTEGER) AS need FROM t),
c AS (SELECT g.user_id, g.page, k, a.event_id = b.event_id AS same, a.event_type = b.event_type AS kind, a.event_id % 3 = 0 AND b.event_id % 3 = 0 AND a.event_id % 2 <> b.event_id % 2 AS off, a.event_id AS ida, abs(a.value - b.value) AS d
      FROM g, (SELECT unnest(generate_series(1, 10)) AS k), (SELECT unnest(generate_series(0, 9)) AS j)
      JOIN x a ON a.user_id = g.user_id AND a.page = g.page AND a.row = size - k + j + 1 JOIN x b ON b.user_id = g.user_id AND b.page = g.page + 1 AND b.row = j + 1 WHERE j < k AND k <= least(size, next)),
v AS (SELECT user_id, page, k, CASE WHEN same THEN 1 - ida % 8 * 0.02::DOUBLE ELSE greatest(0.0::DOUBLE, 0.95::DOUBLE - d / 400) END AS visual, CASE WHEN same THEN 1.0::DOUBLE WHEN kind THEN 0.72::DOUBLE WHEN off THEN -0.35::DOUBLE ELSE 0.0::DOUBLE END AS agree FROM c),
s AS (SELECT user_id, page, k, round(avg(greatest(0::DOUBLE, least(1.15::DOUBLE, visual + greatest(0::DOUBLE, agree) * 0.12::DOUBLE))), 9) AS mean, min(greatest(0::DOUBLE, least(1.15::DOUBLE, visual + greatest(0::DOUBLE, agree) * 0.12::DOUBLE))) AS least, round(avg(agree), 9) AS agree, min(agree) AS worst FROM v GROUP BY ALL),
o AS (SELECT user_id, page, k, CASE WHEN k = 1 THEN mean >= 0.985 ELSE mean >= 0.90 AND least >= 0.79 END AS strict, mean FROM s WHERE worst >= 0 AND (CASE WHEN k = 1 THEN mean >= 0.985 ELSE mean >= 0.90 AND least >= 0.79 END OR (k >= 2 AND mean >= 0.77 AND least >= 0.68 AND agree >= 0.18))),
q AS (SELECT user_id, page, k, round(mean - CASE WHEN strict THEN 0.0::DOUBLE ELSE 0.035::DOUBLE END, 9) AS score, strict, 0 AS last FROM o UNION ALL SELECT user_id, page, 0, 0.0, false, 1 FROM g WHERE next IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, page ORDER BY last, strict DESC, score DESC, k DESC) AS place FROM q),
b AS (SELECT user_id, page, CAST(row_number() OVER (PARTITION BY user_id ORDER BY page) AS INTEGER) AS i FROM g WHERE next IS NOT NULL),
f AS (SELECT user_id, 0 AS i, 0 AS total, 0.0::DOUBLE AS score, []::INTEGER[] AS ks FROM need
      UNION ALL
      SELECT f.user_id, f.i + 1, CAST(f.total + r.k AS INTEGER), max(f.score + r.score * r.k), first(list_append(f.ks, CAST(r.k AS INTEGER)) ORDER BY f.score + r.score * r.k DESC, r.place)
      FROM f JOIN b ON b.user_id = f.user_id AND b.i = f.i + 1 JOIN r ON r.user_id = b.user_id AND r.page = b.page JOIN need ON need.user_id = f.user_id WHERE f.total + r.k <= need GROUP BY f.user_id, f.i + 1, f.total + r.k),
z AS (SELECT need.user_id, need, (SELECT count(*) FROM b WHERE b.user_id = need.user_id) AS n FROM need),
w AS (SELECT z.user_id, need, f.ks AS plan, coalesce((SELECT list(CAST(k AS INTEGER) ORDER BY page) FROM r WHERE r.user_id = z.user_id AND place = 1), []) AS own FROM z LEFT JOIN f ON f.user_id = z.user_id AND f.i = n AND f.total = need)
SELECT user_id, need, need > 0 AND plan IS NOT NULL AS planned, array_to_string(CASE WHEN need > 0 AND plan IS NOT NULL THEN plan ELSE own END, ',') AS ks FROM w
"""


@query("planned_overlaps", PLAN_SQL)
def planned_overlaps(spark, sf_dir):
    """Overlaps of each user's pages that make the expected number of rows, where there is one and a plan reaches it."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("_e"), "event_type", "value")
    rows = event_pages(spark, sf_dir).join(events, F.col("payload") == F.col("_e"))
    rows = rows.select("batch", "page", "row", F.struct(F.col("payload").alias("event_id"), "event_type", "value").alias("payload"))
    a, b = F.col("a.payload"), F.col("b.payload")
    visual = F.when(a["event_id"] == b["event_id"], 1 - a["event_id"] % 8 * 0.02).otherwise(F.greatest(F.lit(0.0), 0.95 - F.abs(a["value"] - b["value"]) / 400))

    def shown(x):
        place = F.when(x["event_id"] % 3 == 0, (x["event_id"] % 2).cast("string")).otherwise("")
        return F.struct(x["event_id"].alias("uid"), F.array(x["event_type"]).alias("top"), place.alias("position"), F.lit("").alias("hand"))

    agree = agreement.row_agreement(shown(a), shown(b))
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("batch")).count()
    user = F.col("batch")
    total = F.when(user % 4 == 0, 0).when(user % 4 == 1, F.floor(F.col("count") / 3)).otherwise(F.col("count"))
    plan = stitch.plan_overlaps(rows, stitch.planned_options(rows, visual, agree), counts.select("batch", total.alias("total")))
    return plan.select(user.alias("user_id"), "need", "planned", F.array_join("ks", ",").alias("ks"))
