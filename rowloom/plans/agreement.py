"""Queries of readings, evidence and agreement, with the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowloom.functions import numbers, text
from rowloom.operators import agreement, match, tiers
from rowloom.plans.matching import EVIDENCE_SQL, LIKE_SQL, evidence
from rowloom.plans.registry import query
from rowloom.plans.search import SIGNS, table
from rowloom.sources import ingest


#: Line numbers repeat within an order, so more columns tell its lines apart.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
IN_ORDER_SQL = f"(PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)})"


def in_order():
    return Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)


@query(
    "compat_search",
    f"""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN k WHEN 1 THEN k || '株1プラモデルガ' ELSE k || 'éffi1⁄2' END AS search_key
FROM (SELECT p_partkey, regexp_replace(lower(p_name), '{SIGNS}', '', 'g') AS k FROM part)
""",
)
def compat_search(spark, sf_dir):
    """Names in full-width letters, half-width kana, circled digits, ligatures and letters with separate marks have plain keys."""
    letters = "abcdefghijklmnopqrstuvwxyz "
    wide = F.translate("p_name", letters, "".join(chr(ord(c) + 0xFEE0) for c in letters[:-1]) + "　")
    shown = F.when(F.col("p_partkey") % 3 == 0, wide).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("㈱①ﾌﾟﾗﾓﾃﾞﾙｶﾞ"))).otherwise(F.concat("p_name", F.lit("éﬃ½")))
    return table(spark, sf_dir, "part").select("p_partkey", text.search_key(shown).alias("search_key"))


@query(
    "table_records",
    r"""
WITH l AS (SELECT page_id, unnest(generate_series(1, len(labels))) AS i, labels, hrefs FROM (
  SELECT page_id, regexp_extract_all(html, p, 1) AS hrefs, list_transform(regexp_extract_all(html, p, 2), lambda x: trim(regexp_replace(replace(x, '&', '+'), '\s+', ' ', 'g'))) AS labels
  FROM pages, (SELECT '<li>\s*<a\s+href="([^"]*)"[^>]*>([^<]*)</a>' AS p))),
r AS (SELECT page_id, labels[i] AS name, replace(hrefs[i], '&', '+') AS href, i FROM l WHERE labels[i] <> '')
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS place, name, href, '' AS rank FROM r
""",
)
def table_records(spark, sf_dir):
    """The links of each page as an HTML table beside a narrower one; the widest table with the named column is read back."""
    pages = ingest.links(table(spark, sf_dir, "pages").select("page_id", "html"))
    plain = lambda c: F.replace(F.col(c), F.lit("&"), F.lit("+"))
    row = F.concat(F.lit("<tr><td>"), plain("label"), F.lit("</td><td>"), plain("href"), F.lit("</td></tr>"))
    bodies = pages.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("item", row.alias("row")))).alias("rows"))
    head = F.lit("<table><tr><th>name</th></tr><tr><td>narrow</td></tr></table><table><tr><th>name</th><th>href</th><th>rank</th></tr>")
    made = bodies.select("page_id", F.concat(head, F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</table>")).alias("html"))
    found = ingest.table_rows(made, "name")
    return found.select("page_id", "place", *[F.element_at("cells", F.lit(c)).alias(c) for c in ("name", "href", "rank")])


def _like(a: str, b: str) -> str:
    import re

    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE " + re.sub(r"\b([ab])\b", lambda m: a if m[1] == "a" else b, LIKE_SQL) + " END"


@query(
    "text_match",
    f"""
WITH n AS (SELECT DISTINCT p_name AS name, p_brand AS brand FROM part),
k AS (SELECT name, brand, regexp_replace(lower(name), '{SIGNS}', '', 'g') AS tk, split_part(name, ' ', 1) AS tf, split_part(name, ' ', 2) AS tg FROM n),
q0 AS (SELECT name AS truth, min(brand) AS hand, left(name, 2) || substr(name, 4) AS read FROM n GROUP BY name),
q AS (SELECT *, replace(read, ' ', '') AS rk, split_part(read, ' ', 1) AS rf, split_part(read, ' ', 2) AS rg FROM q0),
s AS (SELECT truth, hand, name, brand, tf, tg, rf, rg, {_like("rk", "tk")} AS fullname, CASE WHEN rf = '' THEN 0.0::DOUBLE ELSE {_like("rf", "tf")} END AS sur, CASE WHEN rg = '' THEN 0.0::DOUBLE ELSE {_like("rg", "tg")} END AS giv FROM q, k),
w AS (SELECT *, greatest(fullname, (sur * 0.54::DOUBLE + giv * 0.46::DOUBLE) / CASE WHEN rf = '' AND rg = '' THEN 1.0::DOUBLE ELSE CASE WHEN rf <> '' THEN 0.54::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN rg <> '' THEN 0.46::DOUBLE ELSE 0.0::DOUBLE END END) AS like_name, brand = hand AS same FROM s),
t AS (SELECT *, round(like_name * 0.88::DOUBLE + CASE WHEN same THEN 0.055::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN rf <> '' AND abs(len(tf) - len(rf)) > 1 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN rg <> '' AND abs(len(tg) - len(rg)) > 1 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END, 8) AS score FROM w),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY truth ORDER BY score DESC, name || '|' || brand) AS INTEGER) AS place FROM t QUALIFY place <= 12),
m AS (SELECT *, round(max(CASE WHEN place = 1 THEN score END) OVER o - coalesce(max(CASE WHEN place = 2 THEN score END) OVER o, 0.0::DOUBLE), 8) AS margin FROM p WINDOW o AS (PARTITION BY truth))
SELECT truth, name || '|' || brand AS uid, place, score, margin, place = 1 AND ((like_name >= 0.90 AND margin >= 0.018) OR (rf <> '' AND rg <> '' AND sur >= 0.72 AND giv >= 0.64 AND margin >= 0.02)
  OR (like_name >= 0.74 AND same AND margin >= 0.025)) AS accepted FROM m
""",
)
def text_match(spark, sf_dir):
    """Misread names, their third letter lost, against the whole roster of names and brands: the twelve best and whether the first is a match."""
    roster = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")).distinct()
    reads = roster.groupBy(F.col("name").alias("truth")).agg(F.min("brand").alias("hand"))
    reads = reads.withColumn("read", F.concat(F.substring("truth", 1, 2), F.expr("substr(truth, 4)")))
    keys = lambda c, to: [text.name_key(F.col(c)).alias(f"{to}k"), F.split_part(F.col(c), F.lit(" "), F.lit(1)).alias(f"{to}f"), F.split_part(F.col(c), F.lit(" "), F.lit(2)).alias(f"{to}g")]
    rows = roster.select(F.concat_ws("|", "name", "brand").alias("uid"), "brand", *keys("name", "t"))
    asked = reads.select(F.col("truth").alias("query_id"), "hand", *keys("read", "r"))
    like = match.text_score(*[F.col(c) for c in ("rk", "rf", "rg", "tk", "tf", "tg")])
    off = lambda r, t: (F.col(r) != "") & (F.abs(F.length(t) - F.length(r)) > 1)
    same = F.col("brand") == F.col("hand")
    total = numbers.let(like, lambda x: F.struct(F.round(match.text_total(x, same, F.lit(False), F.lit(False), off("rf", "tf"), off("rg", "tg")), 8).alias("total"), x.alias("like")))
    found = match.in_blocks(asked, rows, total, top=12).select("query_id", "uid", "place", "rf", "rg", same.cast("int").alias("meta"), F.col("score.total").alias("score"), F.col("score.like").alias("like"))
    found = match.with_margin(found, none=0.0).withColumn("margin", F.round("margin", 8))
    accepted = (F.col("place") == 1) & match.text_accept(F.col("like"), F.col("meta"), F.col("margin"), (F.col("rf") != "") & (F.col("rg") != ""))
    return found.select(F.col("query_id").alias("truth"), "uid", "place", "score", "margin", accepted.alias("accepted"))


@query(
    "attempt_choice",
    f"""
WITH a AS (SELECT l_orderkey AS row, row_number() OVER {IN_ORDER_SQL} - 1 AS step, l_suppkey % 4 AS uid, CASE WHEN l_quantity = 50 THEN NULL ELSE round(0.5 + l_discount * 4, 4) END AS score, round(l_tax * 3, 4) AS margin, l_returnflag = 'R' AS matched FROM lineitem),
r AS (SELECT * FROM a WHERE score IS NOT NULL),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, step) = 1),
c AS (SELECT * FROM r WHERE matched QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, step) = 1),
f AS (SELECT * FROM r WHERE step = 0 AND matched AND score >= 0.70 AND margin >= 0.18),
j AS (SELECT b.row, f.row IS NOT NULL AS is_first, f.row IS NULL AND NOT b.matched AND coalesce(c.score >= b.score - 0.055 AND c.uid = b.uid, false) AS keep, b, c, f FROM b LEFT JOIN c USING (row) LEFT JOIN f USING (row))
SELECT row, CASE WHEN is_first THEN f.uid WHEN keep THEN c.uid ELSE b.uid END AS uid, CASE WHEN is_first THEN f.score WHEN keep THEN c.score ELSE b.score END AS score,
  CASE WHEN is_first THEN f.margin WHEN keep THEN c.margin ELSE b.margin END AS margin, CASE WHEN is_first THEN f.matched WHEN keep THEN c.matched ELSE b.matched END AS matched,
  CASE WHEN is_first THEN 'first' WHEN keep THEN 'confirmed' ELSE 'best' END AS rule FROM j
""",
)
def attempt_choice(spark, sf_dir):
    """The lines of an order as attempts to read a row."""
    score = F.when(F.col("l_quantity") != 50, F.round(0.5 + F.col("l_discount") * 4, 4))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), (F.row_number().over(in_order()) - 1).alias("step"), (F.col("l_suppkey") % 4).alias("uid"), score.alias("score"), F.round(F.col("l_tax") * 3, 4).alias("margin"), (F.col("l_returnflag") == "R").alias("matched"))
    return agreement.pick_attempt(lines).drop("step")


CASCADE_SQL = f"""
WITH l AS (SELECT *, round(0.4 + l_discount * 4, 4) AS score, round(l_tax * 3, 4) AS margin, l_returnflag = 'R' AS matched, l_suppkey % 3 AS uid, CASE WHEN l_linestatus = 'O' THEN 'x' ELSE '' END AS category FROM lineitem),
n AS (SELECT *, lead(score) OVER o AS score2, lead(matched) OVER o AS matched2, lead(uid) OVER o AS uid2 FROM l WINDOW o AS {IN_ORDER_SQL})
"""


@query(
    "cascade_rules",
    CASCADE_SQL
    + """
SELECT l_orderkey, l_linenumber, category <> '' AND (NOT matched OR margin < 0.16 OR score < 0.67) AS retry, coalesce(score2 >= score + 0.02 OR (NOT matched AND matched2), false) AS retry_wins,
  coalesce(score2 > score + 0.055 OR (matched2 AND NOT matched AND uid = uid2 AND score2 >= score - 0.055), false) AS copy_wins FROM n
""",
)
def cascade_rules(spark, sf_dir):
    """Which rows are read again, and whether the next line's reading, as a retry or as another copy, replaces a line's."""
    read = F.struct((F.col("l_suppkey") % 3).alias("uid"), F.round(0.4 + F.col("l_discount") * 4, 4).alias("score"), (F.col("l_returnflag") == "R").alias("matched"))
    rows = table(spark, sf_dir, "lineitem").withColumns({"p": read, "q": F.lead(read).over(in_order()), "margin": F.round(F.col("l_tax") * 3, 4), "category": F.when(F.col("l_linestatus") == "O", "x").otherwise("")})
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        agreement.needs_retry(F.col("category"), F.col("p.matched"), F.col("margin"), F.col("p.score")).alias("retry"),
        agreement.retry_wins(F.col("p.score"), F.col("p.matched"), F.col("q.score"), F.col("q.matched")).alias("retry_wins"),
        agreement.copy_wins(F.col("p"), F.col("q")).alias("copy_wins"),
    )


@query(
    "half_width_rules",
    """
SELECT p_partkey, name, regexp_matches(name, '^[A-Za-z]{2,}$') OR (regexp_matches(name, '[A-Za-z]') AND len(name) >= 3) AS pool,
  n = 1 AND p_size % 2 = 0 AND CASE WHEN regexp_matches(name, '[^A-Za-z]') THEN score >= 0.58 AND margin * len(name) >= 0.25 ELSE score >= 0.55 AND margin >= 0.12 END AS accepted
FROM (SELECT p_partkey, p_size, CASE p_size % 3 WHEN 0 THEN replace(p_name, ' ', '') WHEN 1 THEN left(p_name, 1) || '郎' ELSE '山' || p_brand END AS name, round(p_size / 60.0::DOUBLE + 0.3, 4) AS score, round((p_partkey % 20) / 100.0::DOUBLE, 4) AS margin, p_partkey % 2 + 1 AS n FROM part)
""",
)
def half_width_rules(spark, sf_dir):
    size = F.col("p_size")
    name = F.when(size % 3 == 0, F.replace("p_name", F.lit(" "), F.lit(""))).when(size % 3 == 1, F.concat(F.left("p_name", F.lit(1)), F.lit("郎"))).otherwise(F.concat(F.lit("山"), "p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.round(size / 60 + 0.3, 4).alias("score"), F.round((F.col("p_partkey") % 20) / 100, 4).alias("margin"), (F.col("p_partkey") % 2 + 1).alias("n"), (size % 2 == 0).alias("fits"))
    return rows.select("p_partkey", "name", agreement.is_latin(F.col("name")).alias("pool"), agreement.half_width_accept(F.col("name"), F.col("score"), F.col("margin"), F.col("n"), F.col("fits")).alias("accepted"))


@query(
    "independent_agreement",
    """
WITH e AS (SELECT l_orderkey AS row, l_suppkey % 3 AS uid, round(l_discount * 10, 4) AS look, nullif(l_returnflag, 'N') AS position, l_linestatus AS hand FROM lineitem),
b AS (SELECT row, nullif(max(uid), 1) AS uid FROM e GROUP BY row),
f AS (SELECT b.row, count(*) AS n, count(DISTINCT position) AS ps, count(DISTINCT hand) AS hs FROM b JOIN e ON b.row = e.row AND b.uid = e.uid WHERE look >= 0.59 GROUP BY b.row)
SELECT b.row, b.uid, CASE WHEN n >= 2 AND ps <= 1 AND hs <= 1 THEN n ELSE 0 END AS agreed FROM b LEFT JOIN f ON b.row = f.row
""",
)
def independent_agreement(spark, sf_dir):
    """The lines of an order as sources of one row."""
    position = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), (F.col("l_suppkey") % 3).alias("uid"), F.round(F.col("l_discount") * 10, 4).alias("look"), position.alias("position"), F.col("l_linestatus").alias("hand"))
    rows = lines.groupBy("row").agg(F.nullif(F.max("uid"), F.lit(1)).alias("uid"))
    return agreement.independent_agreement(rows, lines).select("row", "uid", "agreed")


@query(
    "identity_dedup",
    """
WITH e AS (SELECT event_type, event_id, CASE WHEN event_id % 5 > 0 THEN user_id END AS uid, round(value / 100, 6) AS score, CASE WHEN event_id % 3 > 0 THEN event_id % 100 END AS confidence FROM events)
SELECT * FROM e QUALIFY uid IS NULL OR row_number() OVER (PARTITION BY event_type, uid ORDER BY coalesce(score, 0::DOUBLE) + coalesce(confidence, 0)::DOUBLE / 5000 DESC, event_id) = 1
""",
)
def identity_dedup(spark, sf_dir):
    """One event of each user and type, the best by value and confidence; events without a user all stay."""
    number = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.when(number % 5 > 0, F.col("user_id")).alias("uid"), F.round(F.col("value") / 100, 6).alias("score"), F.when(number % 3 > 0, number % 100).alias("confidence"))
    return agreement.best_per_identity(rows, "uid", "score", "confidence", "event_id", ["event_type"])


@query(
    "identity_order",
    """
WITH e AS (SELECT event_type, event_id, CASE WHEN event_id % 5 > 0 THEN user_id END AS uid, round(value / 100, 6) AS score, CASE WHEN event_id % 3 > 0 THEN event_id % 100 END AS confidence FROM events),
k AS (SELECT * FROM e QUALIFY uid IS NULL OR row_number() OVER (PARTITION BY event_type, uid ORDER BY coalesce(score, 0::DOUBLE) + coalesce(confidence, 0)::DOUBLE / 5000 DESC, event_id) = 1)
SELECT event_type, event_id, uid, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INTEGER) AS place FROM k QUALIFY event_type = 'click' OR place <= 120
""",
)
def identity_order(spark, sf_dir):
    """The rows of identity_dedup in order again, no more than the expected number of a batch, where one is known."""
    total = F.when(F.col("event_type") == "click", 0).otherwise(120)
    return agreement.in_order(identity_dedup(spark, sf_dir), "event_id", total, ["event_type"]).select("event_type", "event_id", "uid", "place")


@query(
    "expected_total",
    """
WITH v AS (SELECT l_partkey, CAST(l_quantity * 5 AS INTEGER) AS q, nullif(l_partkey % 150, 0) AS f FROM lineitem),
g AS (SELECT * FROM v WHERE q BETWEEN 20 AND 200),
c AS (SELECT l_partkey, any_value(f) AS f, q, count(*) AS n FROM g GROUP BY l_partkey, q),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, abs(q - coalesce(f, q)), q) = 1),
m AS (SELECT l_partkey, bool_or(abs(q - f) <= 2) AS near, list_sort(list(q))[count(*) // 2 + 1] AS median FROM g GROUP BY l_partkey),
k AS (SELECT DISTINCT l_partkey, f FROM v)
SELECT k.l_partkey, CAST(CASE WHEN m.median IS NULL THEN coalesce(k.f, 0) WHEN t.n >= 2 THEN t.q WHEN m.near THEN k.f ELSE m.median END AS BIGINT) AS total FROM k LEFT JOIN t USING (l_partkey) LEFT JOIN m USING (l_partkey)
""",
)
def expected_total(spark, sf_dir):
    """The total that the quantities of each part speak for."""
    values = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_quantity") * 5).cast("int").alias("q"))
    return agreement.expected_total(values, ["l_partkey"], "q", F.col("l_partkey") % 150)


@query(
    "row_agreement",
    f"""
WITH l AS (SELECT *, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_suppkey % 5 END AS uid, [l_suppkey % 7, l_partkey % 7] AS top, CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus ELSE '' END AS position, round(l_discount * 10, 4) AS visual, l_quantity AS k FROM lineitem),
p AS (SELECT *, lead(uid) OVER o AS uid2, lead(top) OVER o AS top2, lead(position) OVER o AS position2 FROM l WINDOW o AS {IN_ORDER_SQL} QUALIFY top2 IS NOT NULL),
a AS (SELECT *, CASE WHEN uid = uid2 THEN 1.0::DOUBLE WHEN list_has_any(top, top2) THEN 0.72::DOUBLE WHEN position <> '' AND position2 <> '' AND position <> position2 THEN -0.35::DOUBLE ELSE 0.0::DOUBLE END AS agreement FROM p)
SELECT l_orderkey, l_linenumber, agreement, greatest(0::DOUBLE, least(1.15::DOUBLE, visual + greatest(0::DOUBLE, agreement) * 0.12::DOUBLE)) AS score,
  CASE WHEN k = 1 THEN visual >= 0.745 ELSE visual >= 0.67 AND visual - 0.05 >= 0.58 END AS accepted, CASE WHEN k = 1 THEN visual >= 0.745 ELSE visual >= 0.67 AND visual - 0.05 >= 0.58 END AND (agreement >= 0.06 OR visual >= 0.90) AS decisive FROM a
""",
)
def row_agreement(spark, sf_dir):
    """Neighbouring lines of an order as rows that may be one, and the overlap rule by shapes alone."""
    uid = F.when(F.col("l_returnflag") != "N", F.col("l_suppkey") % 5)
    position = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linestatus")).otherwise("")
    row = F.struct(uid.alias("uid"), F.array(F.col("l_suppkey") % 7, F.col("l_partkey") % 7).alias("top"), position.alias("position"), F.lit("").alias("hand"))
    pairs = table(spark, sf_dir, "lineitem").withColumns({"a": row, "b": F.lead(row).over(in_order()), "visual": F.round(F.col("l_discount") * 10, 4)}).filter("b is not null")
    pairs = pairs.withColumn("agreement", agreement.row_agreement(F.col("a"), F.col("b")))
    accepted, decisive = agreement.shape_overlap(F.col("visual"), F.col("visual") - 0.05, F.col("agreement"), F.col("l_quantity"))
    return pairs.select("l_orderkey", "l_linenumber", "agreement", agreement.overlap_score(F.col("visual"), F.col("agreement")).alias("score"), accepted.alias("accepted"), decisive.alias("decisive"))


@query(
    "hash_distance",
    """
WITH b AS (SELECT vec_id, label, list_transform(generate_series(1, 63), lambda i: embedding[i] > embedding[i + 1]) AS bits FROM embeddings),
f AS (SELECT label, arg_min(bits, vec_id) AS first FROM b GROUP BY label)
SELECT vec_id, CAST(len(list_filter(generate_series(1, 63), lambda i: bits[i] <> first[i])) AS INTEGER) AS distance FROM b JOIN f USING (label)
""",
)
def hash_distance(spark, sf_dir):
    """How many bits of the difference hash of each vector differ from those of its label's first one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", numbers.difference_hash(F.col("embedding")).alias("bits"))
    first = rows.groupBy("label").agg(F.min_by("bits", "vec_id").alias("first"))
    return rows.join(first, "label").select("vec_id", numbers.hamming(F.col("bits"), F.col("first")).alias("distance"))


@query(
    "clean_readings",
    r"""
WITH r AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '合計: ' || p_size * 3 + 10 || ' 人 ' || p_name WHEN 1 THEN p_size || '人 | ' || p_size * 2 || '人  ' || p_brand WHEN 2 THEN '山田々 ' || p_name || 'ヵー12' ELSE p_name END AS reading FROM part),
c AS (SELECT p_partkey, trim(regexp_replace(replace(reading, '|', ' '), '\s+', ' ', 'g')) AS clean FROM r),
n AS (SELECT *, TRY_CAST(nullif(regexp_extract(clean, '(?:合計|含計|会計|馬軒)[^0-9]{0,8}(\d{2,3})\s*人', 1), '') AS INTEGER) AS named,
  list_max(list_filter(list_transform(regexp_extract_all(clean, '(\d{2,3})\s*人', 1), lambda x: x::INTEGER), lambda x: x BETWEEN 20 AND 200)) AS printed FROM c)
SELECT p_partkey, clean, regexp_replace(clean, '[^\p{Han}\p{Hiragana}\p{Katakana}々ヶヵーA-Za-z]', '', 'g') AS name_part, coalesce(named, printed, 0) AS total FROM n
""",
)
def clean_readings(spark, sf_dir):
    """Readings with bars, labels and numbers: cleaned, what may stand in a name, and the total that they print."""
    size = F.col("p_size")
    reading = (
        F.when(size % 4 == 0, F.concat(F.lit("合計: "), size * 3 + 10, F.lit(" 人 "), "p_name"))
        .when(size % 4 == 1, F.concat(size, F.lit("人 ｜ "), size * 2, F.lit("人  "), "p_brand"))
        .when(size % 4 == 2, F.concat(F.lit("山田々 "), "p_name", F.lit("ヵー１２")))
        .otherwise(F.col("p_name"))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", reading.alias("reading"))
    r = F.col("reading")
    return rows.select("p_partkey", text.clean_reading(r).alias("clean"), text.name_part(r).alias("name_part"), text.labelled_total(r).alias("total"))


@query(
    "row_texts",
    r"""
WITH r AS (SELECT p_partkey, ['投', '外', 'x', ''][p_size % 4 + 1] || ' ' || CASE WHEN p_size % 3 = 0 THEN '右 ' ELSE '' END || '山田' || substr('太次三', p_size % 3 + 1, 1) || ' ' || ['一郎', '健', 'ケン'][p_partkey % 3 + 1] || ' ' || CASE WHEN p_size % 5 > 0 THEN CAST(p_size % 9 + 17 AS VARCHAR) || '歳' ELSE p_brand END || ' ' || ['右/左', '左 / 右', '右', '左／両'][p_partkey % 4 + 1] AS reading,
  CASE WHEN p_partkey % 4 = 1 THEN '捕 二 佐藤 花' WHEN p_partkey % 4 = 2 THEN '鈴木12' ELSE '' END AS other FROM part),
c AS (SELECT *, trim(regexp_replace(replace(replace(reading, '|', ' '), '／', '/'), '\s+', ' ', 'g')) AS clean FROM r),
a AS (SELECT *, regexp_extract(clean, '(18|19|20|21|22|23|24)', 1) AS age, regexp_replace(regexp_extract(clean, '([右左]\s*[/／]\s*[右左両])', 1), '\s', '', 'g') AS hand FROM c),
b AS (SELECT *, CASE WHEN age <> '' AND strpos(clean, age) > 1 THEN left(clean, strpos(clean, age) - 1) ELSE clean END AS before FROM a),
t AS (SELECT *, [x FOR x IN string_split(trim(regexp_replace(before, '[0-9A-Za-z/／歳才\s]+', ' ', 'g')), ' ') IF x <> ''] AS bt, [x FOR x IN string_split(trim(regexp_replace(other, '[0-9A-Za-z/／歳才\s]+', ' ', 'g')), ' ') IF x <> ''] AS ot FROM b),
n AS (SELECT *, array_to_string(bt[greatest(1, len(bt) - 1):], ' ') AS by_text, array_to_string(ot[greatest(1, len(ot) - 1):], ' ') AS by_other FROM t)
SELECT p_partkey, clean AS text, age, hand, CASE WHEN list_contains(string_split(clean, ' ')[1:4], '投') THEN '投' WHEN list_contains(string_split(clean, ' ')[1:4], '外') THEN '外' ELSE '' END AS pos, CASE WHEN other <> '' THEN by_other ELSE by_text END AS name,
  array_to_string([x FOR x IN (CASE WHEN other <> '' AND by_other <> by_text THEN [by_other, by_text] ELSE [by_text] END) IF x <> ''], '|') AS names FROM n
""",
)
def row_texts(spark, sf_dir):
    """What the text of a row says: age, hand, position and name, with a second reading of the name preferred."""
    nth = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    size, key = F.col("p_size"), F.col("p_partkey")
    age = F.when(size % 5 > 0, F.concat((size % 9 + 17).cast("string"), F.lit("歳"))).otherwise(F.col("p_brand"))
    reading = F.concat_ws(" ", nth(("投", "外", "x", ""), size % 4), F.concat(F.when(size % 3 == 0, "右 ").otherwise(""), F.lit("山田"), nth(("太", "次", "三"), size % 3)), nth(("一郎", "健", "ケン"), key % 3), age, nth(("右/左", "左 / 右", "右", "左／両"), key % 4))
    other = F.when(key % 4 == 1, "捕 二 佐藤 花").when(key % 4 == 2, "鈴木12").otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", text.row_text(reading, other).alias("r")).select("p_partkey", "r.*")
    return rows.withColumn("names", F.array_join("names", "|"))


@query("name_characters", r"SELECT DISTINCT character FROM (SELECT unnest(string_split(CASE p_size % 3 WHEN 0 THEN '山田' WHEN 1 THEN 'ヵー・' ELSE 'はなx' END || p_name, '')) AS character FROM part) WHERE regexp_matches(character, '[\p{Han}\p{Hiragana}\p{Katakana}々ヶヵー・]')")
def name_characters(spark, sf_dir):
    """The different characters of all names that a reader has to know, found in each row first."""
    name = F.concat(F.when(F.col("p_size") % 3 == 0, "山田").when(F.col("p_size") % 3 == 1, "ヵー・").otherwise("はなx"), "p_name")
    return table(spark, sf_dir, "part").select(F.explode(text.name_characters(name)).alias("character")).distinct()


@query(
    "word_score",
    """
SELECT l_orderkey, l_linenumber, round(greatest(0::DOUBLE, l_discount * 10 * 0.78::DOUBLE + l_tax * 10 * 0.22::DOUBLE) * exp(-abs(ln(greatest(0.15::DOUBLE, l_quantity / 10) / greatest(0.7::DOUBLE, l_linenumber * 0.86::DOUBLE))) * 0.26::DOUBLE), 9) AS score,
  CASE WHEN l_suppkey % 2 = 0 THEN l_linenumber > 2 AND abs(l_quantity * 2 - (l_suppkey % 20 + 16 * (l_suppkey % 4 + 1) + 3.5)) <= CASE WHEN l_returnflag = 'R' THEN 24 ELSE 10 END
       ELSE l_suppkey % 4 + 1 + CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 0 END <= CASE WHEN l_returnflag IN ('R', 'A') THEN 12 ELSE 9 END END AS fits FROM lineitem
""",
)
def word_score(spark, sf_dir):
    """A word's score by its signs and width, and whether a name of such parts fits the row's layout."""
    rows = table(spark, sf_dir, "lineitem")
    score = numbers.word_score(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 10, F.col("l_linenumber"))
    given = F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).otherwise(0)
    fits = numbers.fits_layout(F.col("l_suppkey") % 4 + 1, given, F.col("l_suppkey") % 2 == 0, F.col("l_quantity") * 2, F.col("l_suppkey") % 20, F.col("l_returnflag") == "R", F.col("l_returnflag") == "A")
    return rows.select("l_orderkey", "l_linenumber", F.round(score, 9).alias("score"), fits.alias("fits"))


@query(
    "name_words",
    "WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS family, split_part(p_name, ' ', 2) AS given FROM part) SELECT DISTINCT unnest([family, given, family || given]) AS word FROM n",
)
def name_words(spark, sf_dir):
    """Every family name, given name and both together, once: the words that a reader may expect."""
    parts = table(spark, sf_dir, "part").select(text.split_name(F.col("p_name")).alias("n")).distinct()
    words = F.array(F.col("n.family"), F.col("n.given"), F.concat("n.family", "n.given"))
    return parts.select(F.explode(words).alias("word")).filter("word <> ''").distinct()


@query("result_projection", EVIDENCE_SQL + "SELECT batch, first_index, match, CASE WHEN match IS NULL THEN resolved END AS resolved, coalesce(match, resolved) AS shown, CASE WHEN user_id % 5 = 4 THEN '待確認守位' ELSE ['投手', '捕手', '內野手', '外野手'][user_id % 5 + 1] END AS position FROM e")
def result_projection(spark, sf_dir):
    """Result records: the match or the tentative result, what a row shows, and its group of positions."""
    rows = evidence(spark, sf_dir)
    place = F.element_at(F.array(*map(F.lit, ("投手", "捕手", "三壘手", "外野手", "教練"))), (F.pmod("user_id", F.lit(5)) + 1).cast("int"))
    shown = tiers.display_value(F.col("match"), F.col("resolved"), F.lit(None).cast("long"), F.lit(False))
    return rows.select("batch", "first_index", "match", F.when(F.col("match").isNull(), F.col("resolved")).alias("resolved"), shown.alias("shown"), tiers.position_group(F.lit(""), place).alias("position"))


@query(
    "scalar_rules",
    """
WITH v AS (SELECT p_partkey, 'x__' || replace(p_name, ' ', '_') || CASE p_size % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.webp' WHEN 3 THEN '.pdf' ELSE '.png.txt' END AS file,
  substr('SABCDEFG', p_size % 8 + 1, 1) AS growth, substr('GFEDCBAS', p_size % 7 + 1, 1) AS lim, replace(p_name, ' ', '') AS bare FROM part),
g AS (SELECT ['G','F','E','E+','D','D+','C','C+','B','B+','A','A+','S','S+','SS'] AS grades)
SELECT p_partkey, regexp_matches(lower(file), '\\.(png|jpe?g|webp|bmp)$') AS image, 'x' AS batch, bare || '藪高' AS spaced, bare || '薮高' AS folded,
  CAST(list_position(grades, lim) AS DOUBLE) AS limit_value, CAST(list_position(grades, growth) AS DOUBLE) AS growth_value FROM v, g
""".replace("\\\\", "\\"),
)
def scalar_rules(spark, sf_dir):
    """File names, names without spaces and with folded variants, and growth/limit pairs, made of parts."""
    from rowloom.functions import sortkeys

    size = F.col("p_size")
    ending = F.when(size % 5 == 0, ".PNG").when(size % 5 == 1, ".jpeg").when(size % 5 == 2, ".webp").when(size % 5 == 3, ".pdf").otherwise(".png.txt")
    file = F.concat(F.lit("x__"), F.translate("p_name", " ", "_"), ending)
    pair = F.concat(F.expr("substr('SABCDEFG', p_size % 8 + 1, 1)"), F.lit("／"), F.expr("substr('GFEDCBAS', p_size % 7 + 1, 1)"))
    both = sortkeys.ability_pair(pair)
    bare, folded = text.strip_space(F.concat("p_name", F.lit("　藪 高"))), text.strip_space(F.concat("p_name", F.lit(" 藪　髙")), variants=True)
    return table(spark, sf_dir, "part").select("p_partkey", text.is_image(file).alias("image"), text.batch_of(file).alias("batch"), bare.alias("spaced"), folded.alias("folded"), both["limit"].alias("limit_value"), both["growth"].alias("growth_value"))


@query(
    "vector_likeness",
    """
WITH f AS (SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY label)
SELECT vec_id, round(greatest(0::DOUBLE, 1 - list_sum(list_transform(generate_series(1, len(embedding)), lambda i: abs(embedding[i]::DOUBLE - first[i]::DOUBLE))) / len(embedding)), 6) AS likeness FROM embeddings JOIN f USING (label)
""",
)
def vector_likeness(spark, sf_dir):
    """How alike each vector is to its label's first one, by mean absolute difference."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    first = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("first"))
    return rows.join(first, "label").select("vec_id", F.round(numbers.likeness(F.col("v"), F.col("first")), 6).alias("likeness"))
