"""Queries over series, collated orders and merged evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowloom.functions import sortkeys
from rowloom.operators import match, series, tiers
from rowloom.operators.written import with_place, written
from rowloom.plans.narrowing import GATES_SQL, _like, gated_reads
from rowloom.plans.registry import query
from rowloom.plans.search import table


def hourly(spark, sf_dir):
    """Events by type and hour since 1970."""
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return table(spark, sf_dir, "events").groupBy("event_type", hour.alias("hour")).agg(F.count("*").alias("n"))


HOURS_SQL = """
h0 AS (SELECT event_type, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS hour, count(*) AS n FROM events GROUP BY ALL),
h1 AS (SELECT event_type, unnest(generate_series(min(hour), max(hour))) AS hour FROM h0 GROUP BY event_type),
h AS (SELECT h1.event_type, h1.hour, coalesce(n, 0)::DOUBLE AS n FROM h1 LEFT JOIN h0 USING (event_type, hour))"""


@query(
    "smoothed_pitch",
    f"""
WITH {HOURS_SQL},
k AS (SELECT sum(exp(power(i / 8.0::DOUBLE, 2) * -0.5::DOUBLE)) AS total FROM (SELECT unnest(generate_series(-24, 24)) AS i)),
s AS (SELECT a.event_type, a.hour, round(any_value(a.n) - sum(b.n * exp(power((b.hour - a.hour) / 8.0::DOUBLE, 2) * -0.5::DOUBLE)) / any_value(total), 9) AS z FROM h a JOIN h b ON a.event_type = b.event_type AND abs(a.hour - b.hour) <= 24, k GROUP BY a.event_type, a.hour),
q AS (SELECT event_type, hour - min(hour) OVER w AS q, max(hour) OVER w - min(hour) OVER w + 1 AS h, z FROM s WINDOW w AS (PARTITION BY event_type)),
l AS (SELECT a.event_type, lag, round(sum(a.z * b.z) / sqrt(greatest(1e-9::DOUBLE, sum(a.z * a.z) * sum(b.z * b.z))), 9) AS c FROM q a, (SELECT CAST(unnest(generate_series(25, 55)) AS INTEGER) AS lag), q b
      WHERE a.event_type = b.event_type AND b.q = a.q + lag AND a.q >= floor(a.h * 0.27) AND b.q < floor(a.h * 0.90) GROUP BY ALL)
SELECT event_type, lag, round(c, 6) AS correlation FROM l QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY c DESC, lag) = 1
""",
)
def smoothed_pitch(spark, sf_dir):
    """The pitch of hourly counts less their smoothed course."""
    rows = series.smoothed(series.dense(hourly(spark, sf_dir), ["event_type"], "hour", "n"), ["event_type"], "hour", "n")
    rows = rows.withColumn("z", F.round(F.col("n") - F.col("smooth"), 9))
    return series.best_lag(rows, ["event_type"], "hour", "z").withColumn("correlation", F.round("correlation", 6))


@query(
    "widest_run",
    f"""
WITH {HOURS_SQL},
w AS (SELECT event_type, hour // 168 AS week, hour % 168 AS pos, n / max(n) OVER (PARTITION BY event_type, hour // 168) AS fill FROM h),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY event_type, week ORDER BY pos) AS island FROM w WHERE fill > 0.46 AND pos >= floor(168 * 0.18) AND pos < floor(168 * 0.44)),
b AS (SELECT event_type, week, min(pos) AS a, max(pos) + 1 AS b, count(*) AS width FROM r GROUP BY event_type, week, island HAVING count(*) >= 4 QUALIFY row_number() OVER (PARTITION BY event_type, week ORDER BY count(*) DESC, min(pos)) = 1)
SELECT k.event_type, k.week, round(coalesce(a / 168.0::DOUBLE, 0.285), 6) AS left_share, round(coalesce(b / 168.0::DOUBLE, 0.325), 6) AS right_share, width FROM (SELECT DISTINCT event_type, week FROM w) k LEFT JOIN b USING (event_type, week)
""",
)
def widest_run(spark, sf_dir):
    """Where the longest busy stretch of each week lies, within a part of the week; a default where there is none."""
    rows = series.dense(hourly(spark, sf_dir), ["event_type"], "hour", "n").withColumns({"week": F.floor(F.col("hour") / 168), "at": F.col("hour") % 168})
    fill = F.col("n") / F.max("n").over(Window.partitionBy("event_type", "week"))
    found = series.widest_run(rows.withColumn("fill", fill), ["event_type", "week"], "at", F.col("fill") > 0.46, F.floor(F.lit(168 * 0.18)), F.floor(F.lit(168 * 0.44)))
    share = lambda c, default: F.round(F.coalesce(F.col(c) / 168, F.lit(default)), 6)
    return found.select("event_type", "week", share("start", 0.285).alias("left_share"), share("stop", 0.325).alias("right_share"), "width")


# ---- collated order


SPELLINGS_SQL = """
s AS (SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '—' WHEN 2 THEN upper(p_name) WHEN 3 THEN replace(replace(p_name, 'o', 'ö'), 'e', 'É') WHEN 4 THEN 'item ' || p_size || ' ' || p_name WHEN 5 THEN 'Ítem ' || p_size WHEN 6 THEN CAST(p_size AS VARCHAR) || '歳'
  WHEN 7 THEN ['カタ', 'かた', 'ガタ', 'がた', 'ハナ', 'はな'][p_size % 6 + 1] || p_size % 4 WHEN 8 THEN substr('SABCDEFG', p_size % 8 + 1, 1) ELSE p_name END AS shown FROM part)"""


@query(
    "collated_order",
    f"""
WITH {SPELLINGS_SQL},
k AS (SELECT *, coalesce(trim(shown), '') IN ('', '—') AS blank, CASE WHEN regexp_full_match(shown, '[0-9]+歳') THEN CAST(replace(shown, '歳', '') AS DOUBLE) WHEN shown IN ('S','A','B','C','D','E','F','G') THEN list_position(['G','F','E','E+','D','D+','C','C+','B','B+','A','A+','S','S+','SS'], shown)::DOUBLE END AS number FROM s),
t AS (SELECT *, CASE WHEN number IS NULL AND NOT blank THEN lower(array_to_string(list_transform(regexp_extract_all(shown, '([0-9]+|[^0-9]+)', 1), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN lpad(CAST(len(regexp_replace(p, '^0+(.)', '\\1')) AS VARCHAR), 10, '0') || regexp_replace(p, '^0+(.)', '\\1') ELSE p END), '')) END AS txt FROM k),
f AS (SELECT *, translate(strip_accents(txt), 'カタガハナ', 'かたかはな') AS base FROM t)
SELECT p_partkey, shown, CAST(dense_rank() OVER (ORDER BY blank, number ASC NULLS LAST, base COLLATE ja ASC NULLS FIRST) AS INTEGER) AS place FROM f
""",
)
def collated_order(spark, sf_dir):
    """Numbers, then texts without regard to case, accents and kind of kana, numbers inside them by value; blanks last. Equal keys share a place."""
    size, name = F.col("p_size"), F.col("p_name")
    kana = F.element_at(F.array(*map(F.lit, ("カタ", "かた", "ガタ", "がた", "ハナ", "はな"))), (size % 6 + 1).cast("int"))
    kind = F.col("p_partkey") % 10
    shown = (
        F.when(kind == 0, F.lit(None))
        .when(kind == 1, "—")
        .when(kind == 2, F.upper(name))
        .when(kind == 3, F.translate(name, "oe", "öÉ"))
        .when(kind == 4, F.concat(F.lit("item "), size, F.lit(" "), name))
        .when(kind == 5, F.concat(F.lit("Ítem "), size))
        .when(kind == 6, F.concat(size, F.lit("歳")))
        .when(kind == 7, F.concat(kana, size % 4))
        .when(kind == 8, F.expr("substr('SABCDEFG', p_size % 8 + 1, 1)"))
        .otherwise(name)
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", shown.alias("shown"))
    keyed = rows.withColumn("key", sortkeys.collated_key(F.col("shown"))).select("p_partkey", "shown", "key.*")
    keys = with_place(keyed.groupBy("blank", "number", "text").agg(F.count("*").alias("n")).withColumn("key", F.struct("blank", "number", "text")), sortkeys.collated_ordering("key"))
    same = F.col("blank") == F.col("_b")
    for a, b in (("number", "_n"), ("text", "_t")):
        same &= F.col(a).eqNullSafe(F.col(b))
    placed = keys.select(F.col("blank").alias("_b"), F.col("number").alias("_n"), F.col("text").alias("_t"), F.col("place").cast("int").alias("place"))
    return keyed.join(placed, same).select("p_partkey", "shown", "place")


# ---- merged evidence


MERGE_SQL = f"""
{GATES_SQL.replace("q AS (", "q0 AS (", 1).split("g1 AS (")[0].rstrip().rstrip(",")},
reads AS (SELECT query_id, c, query_id * 3 + c AS number, CASE WHEN c = 1 THEN left(rf, 1) || substr(rf, 3) WHEN c = 2 THEN '' ELSE rf END AS rf, CASE WHEN c = 0 THEN '' WHEN c = 2 THEN substr(rg, 2) ELSE rg END AS rg,
  CASE WHEN c = 1 THEN rp ELSE '' END AS rp, CASE WHEN c = 2 THEN rh ELSE '' END AS rh, CASE WHEN c = 0 THEN ra END AS ra, (query_id + c * 37) % 100 AS confidence FROM q0, (SELECT unnest([0, 1, 2]) AS c)),
each AS (SELECT number AS key, query_id, [n FOR n IN [rf || rg] IF n <> ''] AS names, [n FOR n IN [rf] IF n <> ''] AS families, [n FOR n IN [rg] IF n <> ''] AS givens, rp, rh, ra FROM reads),
merged AS (SELECT query_id AS key, query_id, list_distinct(list(rf || rg) FILTER (WHERE rf || rg <> '')) AS names, list_distinct(list(rf ORDER BY c) FILTER (WHERE rf <> '')) AS families, list_distinct(list(rg) FILTER (WHERE rg <> '')) AS givens,
  coalesce(first(rp ORDER BY c) FILTER (WHERE rp <> ''), '') AS rp, coalesce(first(rh ORDER BY c) FILTER (WHERE rh <> ''), '') AS rh, first(ra ORDER BY c) FILTER (WHERE ra IS NOT NULL) AS ra,
  first(rf ORDER BY c) FILTER (WHERE rf <> '') AS rf1, first(rg ORDER BY c) FILTER (WHERE rg <> '') AS rg1, max(confidence) AS confidence, min(number) AS first_index, count(*) AS n FROM reads GROUP BY query_id),
asked AS (SELECT 'each' AS kind, key, query_id, names, families, givens, rp, rh, ra, families[1] AS rf1, givens[1] AS rg1 FROM each UNION ALL SELECT 'merged', key, query_id, names, families, givens, rp, rh, ra, rf1, rg1 FROM merged),
g1 AS (SELECT * FROM (SELECT asked.*, r.uid, r.family, r.given, r.position, r.hand, r.age, rp <> '' AND count(*) FILTER (WHERE position = rp) OVER (PARTITION BY kind, key) >= 1 AS by_position FROM asked, r) WHERE NOT by_position OR position = rp),
g2 AS (SELECT * FROM (SELECT *, rh <> '' AND count(*) FILTER (WHERE hand = rh) OVER (PARTITION BY kind, key) >= 1 AS by_hand FROM g1) WHERE NOT by_hand OR hand = rh),
l AS (SELECT *, family || given AS tk, coalesce(list_max(list_transform(names, lambda z: {_like("z", "tk")})), 0) AS fullname, coalesce(list_max(list_transform(families, lambda z: {_like("z", "family")})), 0) AS sur, coalesce(list_max(list_transform(givens, lambda z: {_like("z", "given")})), 0) AS giv FROM (SELECT *, family || given AS tk FROM g2)),
t AS (SELECT *, round(greatest(fullname, (sur * 0.54::DOUBLE + giv * 0.46::DOUBLE) / CASE WHEN len(families) = 0 AND len(givens) = 0 THEN 1.0::DOUBLE ELSE CASE WHEN len(families) > 0 THEN 0.54::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len(givens) > 0 THEN 0.46::DOUBLE ELSE 0.0::DOUBLE END END) * 0.88::DOUBLE
   + CASE WHEN rh <> '' AND hand = rh THEN 0.055::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN rp <> '' AND position = rp THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN coalesce(age = ra, false) THEN 0.008::DOUBLE ELSE 0.0::DOUBLE END
   - CASE WHEN rf1 <> '' AND abs(len(family) - len(rf1)) > 1 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN rg1 <> '' AND abs(len(given) - len(rg1)) > 1 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END, 8) AS score FROM l),
best AS (SELECT kind, key, query_id, uid, score FROM t WHERE len(names) > 0 QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY score DESC, uid) = 1),
kept AS (SELECT query_id, first(uid ORDER BY score DESC, key) AS uid, max(score) AS score FROM best WHERE kind = 'each' GROUP BY query_id)
"""


@query(
    "evidence_rematch",
    f"""
WITH {MERGE_SQL}
SELECT m.query_id, CAST(coalesce(len(m.names), 0) AS INTEGER) AS names, m.rp AS position, m.rh AS hand, CAST(m.ra AS INTEGER) AS age, m.confidence, m.first_index, m.n, k.uid AS kept_uid, k.score AS kept_score, CASE WHEN b.score > k.score THEN b.uid ELSE k.uid END AS uid, greatest(k.score, b.score) AS score, coalesce(b.score > k.score, false) AS rematched
FROM merged m LEFT JOIN kept k USING (query_id) LEFT JOIN best b ON b.kind = 'merged' AND b.query_id = m.query_id
""",
)
def evidence_rematch(spark, sf_dir):
    """Three readings of each record put together and matched anew: the merged evidence replaces the best single reading where it scores higher."""
    rows, reads = gated_reads(spark, sf_dir)
    c = F.col("copy")
    blank = F.lit("")
    many = reads.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    family = F.when(c == 1, F.concat(F.left("family", F.lit(1)), F.expr("substr(family, 3)"))).when(c == 2, blank).otherwise(F.col("family"))
    given = F.when(c == 0, blank).when(c == 2, F.expr("substr(given, 2)")).otherwise(F.col("given"))
    many = many.select("query_id", (F.col("query_id") * 3 + c).alias("number"), family.alias("family"), given.alias("given"), F.when(c == 1, F.col("position")).otherwise(blank).alias("position"), F.when(c == 2, F.col("hand")).otherwise(blank).alias("hand"), F.when(c == 0, F.col("age")).alias("age"), ((F.col("query_id") + c * 37) % 100).alias("confidence"))
    # single readings have even keys, merged ones odd
    one = tiers.as_evidence(many, "number", "number").withColumn("key", F.col("key") * 2)
    merged = written(tiers.as_evidence(many, "query_id", "number"), "merged-readings")
    found = match.evidence_matches(one.unionByName(merged.withColumn("key", F.col("key") * 2 + 1)), rows)
    found = written(found.select(F.floor(F.col("key") / 2).alias("number"), (F.pmod("key", F.lit(2)) == 1).alias("is_merged"), "uid", "score"), "evidence-matches")
    each = found.filter("not is_merged").withColumn("query_id", F.floor(F.col("number") / 3))
    kept = each.groupBy("query_id").agg(F.max_by(F.struct("uid", "score"), F.struct(F.col("score"), -F.col("number"))).alias("kept"))
    again = found.filter("is_merged").select(F.col("number").alias("_k"), F.struct("uid", "score").alias("again"))
    out = merged.join(kept, F.col("key") == F.col("query_id"), "left").join(again, F.col("key") == F.col("_k"), "left")
    better = F.coalesce(F.col("again.score") > F.col("kept.score"), F.lit(False))
    return out.select(
        F.col("key").alias("query_id"),
        F.size("names").alias("names"),
        "position",
        "hand",
        "age",
        "confidence",
        "first_index",
        "n",
        F.col("kept.uid").alias("kept_uid"),
        F.col("kept.score").alias("kept_score"),
        F.when(better, F.col("again.uid")).otherwise(F.col("kept.uid")).alias("uid"),
        F.greatest("kept.score", "again.score").alias("score"),
        better.alias("rematched"),
    )


# ---- arrivals


@query(
    "group_arrivals",
    """
WITH s AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, arg_max(event_id, value * 1000000 - event_id * 1e-6) AS top, bool_or(user_id % 6 = 0 AND event_id % 10 = 0) AS late FROM events GROUP BY user_id)
SELECT user_id, n, kinds, top, CAST(CASE WHEN late THEN 1 ELSE user_id % 3 END AS BIGINT) AS version FROM s
""",
)
def group_arrivals(spark, sf_dir):
    """Events that arrive in three steps, some late and some again: each user's result and the step that built it last."""
    from rowloom.operators.written import work_folder
    from rowloom.streaming import groups

    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    folder = work_folder(spark, "arrivals")
    late = (F.col("user_id") % 6 == 0) & (F.col("event_id") % 10 == 0)
    step = F.when(late, 1).otherwise(F.col("user_id") % 3)
    again = (F.col("user_id") % 3 == 0) & ~late & (F.col("event_id") % 7 == 0)

    def build(rows):
        top = F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id")))
        return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), top.alias("top"))

    for n in range(3):
        arriving = events.filter((step == n) | (again if n == 2 else F.lit(False)))
        arriving.write.parquet(f"{folder}/inbox/step-{n}")
        groups.follow(spark, f"{folder}/inbox", events.schema, f"{folder}/kept", ["event_id"], "user_id", build)
    return groups.results(spark, f"{folder}/kept", "user_id", build(events).schema).select("user_id", "n", "kinds", "top", "version")
