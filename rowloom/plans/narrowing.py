"""Queries that narrow before they score: soft gates, coarse-to-fine search, overlaps by shifted masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowloom.functions import numbers
from rowloom.operators import gates, match, names, vectors
from rowloom.plans.matching import LIKE_SQL
from rowloom.plans.registry import query
from rowloom.plans.search import table

# ---- soft gates


def _like(a: str, b: str) -> str:
    import re

    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE " + re.sub(r"\b([ab])\b", lambda m: a if m[1] == "a" else b, LIKE_SQL) + " END"


#: What each query reads of a record, by its number n: parts unread, a family name cut to its first word, a letter lost, gates that leave nothing.
GATES_SQL = f"""
r AS (SELECT p_partkey AS uid, split_part(p_name, ' ', 1) || replace(p_brand, 'Brand#', '') AS family, split_part(p_name, ' ', 2) || lower(p_type) AS given, ['投手', '捕手', '一壘手', '外野手', ''][p_size % 5 + 1] AS position, ['r/r', 'r/l', 'l/l'][p_partkey % 3 + 1] AS hand, p_size % 7 + 18 AS age, p_partkey // 20 AS n FROM part),
q AS (SELECT uid AS query_id, CASE WHEN n % 6 = 5 THEN '' WHEN n % 9 = 7 THEN regexp_replace(family, '[0-9]+', '') ELSE left(family, 2) || substr(family, 4) END AS rf, CASE WHEN n % 7 = 6 THEN '' ELSE left(given, 3) || substr(given, 5) END AS rg,
   CASE WHEN n % 10 = 4 THEN '二壘手' WHEN n % 2 = 0 THEN position ELSE '' END AS rp, CASE WHEN n % 15 = 9 THEN 'l/r' WHEN n % 3 = 0 THEN hand ELSE '' END AS rh, CASE WHEN n % 5 = 0 THEN age END AS ra,
   CASE WHEN n % 8 < 6 THEN len(family) + CASE WHEN n % 4 = 3 THEN 20 ELSE 0 END END AS fl, CASE WHEN n % 5 < 4 THEN len(given) + CASE WHEN n % 4 = 1 THEN 40 ELSE 0 END END AS gl FROM r WHERE uid % 20 = 0),
g1 AS (SELECT * FROM (SELECT q.*, r.*, rp <> '' AND count(*) FILTER (WHERE position = rp) OVER (PARTITION BY query_id) >= 1 AS by_position FROM q, r) WHERE NOT by_position OR position = rp),
g2 AS (SELECT * FROM (SELECT *, rh <> '' AND count(*) FILTER (WHERE hand = rh) OVER (PARTITION BY query_id) >= 1 AS by_hand FROM g1) WHERE NOT by_hand OR hand = rh),
g3a AS (SELECT *, round({_like("rf", "family")}, 9) AS t FROM g2),
g3b AS (SELECT *, max(t) OVER (PARTITION BY query_id) AS best FROM g3a),
g3c AS (SELECT *, t >= greatest(0.42::DOUBLE, round(best - 0.08::DOUBLE, 9)) AS short FROM g3b),
g3 AS (SELECT * FROM (SELECT *, rf <> '' AND best >= 0.48 AND count(*) FILTER (WHERE short) OVER (PARTITION BY query_id) BETWEEN 1 AND 220 AS by_family FROM g3c) WHERE NOT by_family OR short),
g4 AS (SELECT * FROM (SELECT *, fl IS NOT NULL AND count(*) FILTER (WHERE abs(len(family) - fl) <= 1) OVER (PARTITION BY query_id) >= 1 AS by_family_length FROM g3) WHERE NOT by_family_length OR abs(len(family) - fl) <= 1),
g5 AS (SELECT * FROM (SELECT *, gl IS NOT NULL AND count(*) FILTER (WHERE abs(len(given) - gl) <= 1) OVER (PARTITION BY query_id) >= 1 AS by_given_length FROM g4) WHERE NOT by_given_length OR abs(len(given) - gl) <= 1)"""


def gated_reads(spark, sf_dir):
    """Records with family and given names, and what each record whose id divides by 20 was read as."""
    nth = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    part = F.split(F.col("p_name"), " ")
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        key.alias("uid"),
        F.concat(F.get(part, 0), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("family"),
        F.concat(F.get(part, 1), F.lower("p_type")).alias("given"),
        nth(("投手", "捕手", "一壘手", "外野手", ""), size % 5).alias("position"),
        nth(("r/r", "r/l", "l/l"), key % 3).alias("hand"),
        (size % 7 + 18).alias("age"),
    )
    n = F.floor(F.col("uid") / 20)
    family = F.when(n % 6 == 5, "").when(n % 9 == 7, F.regexp_replace("family", "[0-9]+", "")).otherwise(F.concat(F.substring("family", 1, 2), F.expr("substr(family, 4)")))
    given = F.when(n % 7 == 6, "").otherwise(F.concat(F.substring("given", 1, 3), F.expr("substr(given, 5)")))
    reads = rows.filter("uid % 20 = 0").select(
        F.col("uid").alias("query_id"),
        family.alias("family"),
        given.alias("given"),
        F.when(n % 10 == 4, "二壘手").when(n % 2 == 0, F.col("position")).otherwise("").alias("position"),
        F.when(n % 15 == 9, "l/r").when(n % 3 == 0, F.col("hand")).otherwise("").alias("hand"),
        F.when(n % 5 == 0, F.col("age")).alias("age"),
        F.when(n % 8 < 6, F.length("family") + F.when(n % 4 == 3, 20).otherwise(0)).alias("family_length"),
        F.when(n % 5 < 4, F.length("given") + F.when(n % 4 == 1, 40).otherwise(0)).alias("given_length"),
    )
    return rows, reads


@query(
    "soft_gates",
    f"WITH {GATES_SQL} SELECT query_id, by_position, by_hand, by_family, by_family_length, by_given_length, count(*) AS pool FROM g5 GROUP BY ALL",
)
def soft_gates(spark, sf_dir):
    """Which gates each query takes, and how many records they leave."""
    rows, reads = gated_reads(spark, sf_dir)
    return gates.narrowed(reads, rows).select("query_id", *gates.FLAGS, "pool")


@query(
    "gated_text_match",
    f"""
WITH {GATES_SQL},
s AS (SELECT *, rf || rg AS rk, family || given AS tk FROM g5),
l AS (SELECT *, {_like("rk", "tk")} AS fullname, {_like("rf", "family")} AS sur, {_like("rg", "given")} AS giv, hand = rh AND rh <> '' AS same_hand, position = rp AND rp <> '' AS same_position, coalesce(age = ra, false) AS same_age FROM s),
w AS (SELECT *, greatest(fullname, (sur * 0.54::DOUBLE + giv * 0.46::DOUBLE) / CASE WHEN rf = '' AND rg = '' THEN 1.0::DOUBLE ELSE CASE WHEN rf <> '' THEN 0.54::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN rg <> '' THEN 0.46::DOUBLE ELSE 0.0::DOUBLE END END) AS like_name, CAST(same_hand AS INTEGER) + CAST(same_position AS INTEGER) AS meta FROM l),
t AS (SELECT *, round(like_name * 0.88::DOUBLE + CASE WHEN same_hand THEN 0.055::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN same_position THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN same_age THEN 0.008::DOUBLE ELSE 0.0::DOUBLE END
   - CASE WHEN rf <> '' AND abs(len(family) - len(rf)) > 1 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN rg <> '' AND abs(len(given) - len(rg)) > 1 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END, 8) AS score FROM w),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS INTEGER) AS place FROM t QUALIFY place <= 12),
m AS (SELECT *, round(max(CASE WHEN place = 1 THEN score END) OVER o - coalesce(max(CASE WHEN place = 2 THEN score END) OVER o, 0.0::DOUBLE), 8) AS margin FROM p WINDOW o AS (PARTITION BY query_id))
SELECT query_id, uid, place, score, meta, margin, place = 1 AND ((like_name >= 0.90 AND margin >= 0.018) OR (rf <> '' AND rg <> '' AND sur >= 0.72 AND giv >= 0.64 AND margin >= 0.02)
  OR (like_name >= 0.74 AND meta >= 1 AND margin >= 0.025) OR (like_name >= 0.68 AND meta >= 2 AND margin >= 0.02)) AS accepted FROM m
""",
)
def gated_text_match(spark, sf_dir):
    """Readings against the records that their gates leave: the twelve best and whether the first is a match; two agreeing facts lower what the name owes."""
    rows, reads = gated_reads(spark, sf_dir)
    c = F.col
    read = lambda x: F.coalesce(c(x), F.lit(""))
    known = lambda x: F.when(x != "", F.array(x)).otherwise(F.array().cast("array<string>"))
    asked = reads.select("query_id", known(F.concat(read("family"), read("given"))).alias("names"), known(read("family")).alias("families"), known(read("given")).alias("givens"), *[c(x).alias(f"r_{x}") for x in ("family", "given", "position", "hand", "age")])
    taken = gates.narrowed(reads, rows).select(c("query_id").alias("_q"), "position", "hand", c("families").alias("short"), "family_length", "given_length")
    best = names.best_named(asked.join(taken, c("query_id") == c("_q")).drop("_q"), rows, "query_id", top=12)
    best = match.with_margin(best, none=0.0).withColumn("margin", F.round("margin", 8))
    like = {x: c(x) for x in ("name", "sur", "giv")}
    both = reads.select(c("query_id").alias("_q"), ((c("family") != "") & (c("given") != "")).alias("both"))
    best = best.join(both, c("query_id") == c("_q"))
    accepted = (c("place") == 1) & match.text_accept(like, c("meta"), c("margin"), c("both"))
    return best.select("query_id", "uid", "place", "score", "meta", "margin", accepted.alias("accepted"))


# ---- coarse to fine


COARSE_SQL = """
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, v, list_transform(v[1:16], lambda x: x - list_sum(v[1:16]) / 16) AS m FROM e),
a AS (SELECT vec_id, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m) + 1e-8)) AS c, list_transform(v, lambda x: x - list_sum(v) / 64) AS w FROM u),
n AS (SELECT vec_id, c, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w) + 1e-8)) AS f FROM a),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS uid, round(list_inner_product(q.c, r.c), 6) AS coarse, round(list_inner_product(q.f, r.f), 6) AS fine FROM n q, n r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coarse DESC, uid) AS rank FROM s QUALIFY rank <= 18),
x AS (SELECT query_id, arg_max(uid, fine - uid * 1e-12) AS exact_uid FROM s GROUP BY query_id),
g AS (SELECT *, max(coarse) OVER (PARTITION BY query_id) AS top, max(CASE WHEN rank = 2 THEN coarse END) OVER (PARTITION BY query_id) AS second FROM k),
h AS (SELECT *, top >= 0.35 AND NOT (top >= 0.60 AND round(top - coalesce(second, -9), 6) >= 0.14) AS open FROM g),
z AS (SELECT *, CASE WHEN open AND rank <= 14 THEN round(coarse + greatest(0::DOUBLE, least(0.065::DOUBLE, (fine - coarse) * 0.38::DOUBLE)), 6) ELSE coarse END AS score FROM h),
o AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) = 1),
w AS (SELECT query_id, arg_max(uid, fine - uid * 1e-12) AS refined_uid FROM k GROUP BY query_id)"""


@query("coarse_to_fine", f"WITH {COARSE_SQL} SELECT o.query_id, o.uid, o.score, o.open AS refined, w.refined_uid, x.exact_uid, w.refined_uid = x.exact_uid AS kept FROM o JOIN x USING (query_id) JOIN w USING (query_id)")
def coarse_to_fine(spark, sf_dir):
    """A first search on a quarter of the dimensions, then fine scores of what it leaves.

    uid: the best after the bounded refinement of ambiguous queries. refined_uid: the best of the 18 kept by fine score;
    kept: whether that is the best of all rows (exact_uid).
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", numbers.centred(F.slice("embedding", 1, 16)).alias("c"), numbers.centred(F.col("embedding")).alias("f"))
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("c").alias("qc"), F.col("f").alias("qf"))
    held = rows.withColumnRenamed("vec_id", "uid")
    # a query's own row stands behind all others, so it takes no place of theirs
    coarse = vectors.best_by_product(asked, held, ("qc", "c"), top=18, own=-9.0, more={"fine": ("qf", "f")}).filter("score is not null and uid <> query_id")
    found = match.refine(coarse.withColumnRenamed("score", "coarse"))
    exact = vectors.best_by_product(asked.drop("qc"), held.drop("c"), ("qf", "f"), top=1, own=-9.0).filter("uid <> query_id").select(F.col("query_id").alias("_q"), F.col("uid").alias("exact_uid"))
    return found.join(exact, F.col("query_id") == F.col("_q")).select("query_id", "uid", "score", "refined", "refined_uid", "exact_uid", (F.col("refined_uid") == F.col("exact_uid")).alias("kept"))


@query("coarse_to_fine_recall", f"WITH {COARSE_SQL} SELECT count(*) AS n, round(avg(CASE WHEN w.refined_uid = x.exact_uid THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS kept_share, count(*) FILTER (WHERE o.open) AS refined FROM o JOIN x USING (query_id) JOIN w USING (query_id)")
def coarse_to_fine_recall(spark, sf_dir):
    """The share of queries whose exact best the first search keeps."""
    return coarse_to_fine(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("kept"), 1.0).otherwise(0.0)), 6).alias("kept_share"), F.count_if("refined").alias("refined"))


# ---- overlaps by shifted masks


WIDTH, HEIGHT = 32, 16

#: Vectors as rows of pages: bits where an entry is high, moved and thinned by page; each batch's pages overlap by 4, 1 or 2 rows.
MASKS_SQL = """
b AS (SELECT vec_id, vec_id % 23 AS batch, [4, 1, 2][vec_id % 23 % 3 + 1] AS o, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY vec_id) AS n, 11 - o AS step FROM b),
g AS (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((n - 11) / step::DOUBLE) AS BIGINT)), (n - 1) // step)) AS page FROM n),
r AS (SELECT batch, page, n - page * step AS row, vec_id, [0, 2, -1, 1][page % 4 + 1] AS dx, [-1, 0, 1][page % 3 + 1] AS dy, list_transform(v, lambda x: x - list_sum(v) / 64) AS w, v FROM g),
l AS (SELECT *, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w) + 1e-8)) AS u,
  list_transform(generate_series(0, 15), lambda y: CAST(list_sum(list_transform(generate_series(0, 31), lambda x: CASE WHEN v[((x - dx + 640) // 4 + 5 * (y - dy) + 640) % 64 + 1] > 0.06
    AND CASE page % 5 WHEN 1 THEN (x + y) % 7 > 0 WHEN 2 THEN x % 2 = 0 WHEN 3 THEN (x + 2 * y) % 5 > 1 ELSE true END THEN 1::BIGINT << x ELSE 0 END)) AS BIGINT)) AS mask0 FROM r),
i AS (SELECT *, CAST(list_sum(list_transform(mask0, lambda m: bit_count(m))) AS INTEGER) AS ink0 FROM l),
m AS (SELECT batch, page, row, u, CASE WHEN ink0 BETWEEN 36 AND 0.46 * 512 THEN mask0 END AS mask, ink0 AS ink FROM i),
z AS (SELECT batch, page, CAST(count(*) AS INTEGER) AS size, lead(count(*)) OVER (PARTITION BY batch ORDER BY page) AS next, lead(page) OVER (PARTITION BY batch ORDER BY page) AS next_page FROM m GROUP BY batch, page),
c AS (SELECT z.batch, z.page, k, a.row AS row_a, b.row AS row_b, a.mask AS am, b.mask AS bm, a.ink + b.ink AS total, greatest(0.0::DOUBLE, round(list_inner_product(a.u, b.u) * (1 - (z.page * 3 + z.batch) % 6 * 0.06::DOUBLE), 6)) AS shape
      FROM z, (SELECT CAST(unnest(generate_series(1, 11)) AS INTEGER) AS k), (SELECT unnest(generate_series(0, 10)) AS j) JOIN m a ON a.batch = z.batch AND a.page = z.page AND a.row = size - k + j + 1 JOIN m b ON b.batch = z.batch AND b.page = z.next_page AND b.row = j + 1 WHERE j < k AND k <= least(size, next)),
d AS (SELECT *, unnest(generate_series(-3, 3)) AS dy FROM c WHERE am IS NOT NULL AND bm IS NOT NULL),
e AS (SELECT * EXCLUDE (am, bm), am, bm, 2.0::DOUBLE * list_sum(list_transform(generate_series(0, 15), lambda y: CASE WHEN y - dy BETWEEN 0 AND 15 THEN bit_count(am[y + 1] & bm[y - dy + 1]) ELSE 0 END)) / total AS dice FROM d),
f AS (SELECT *, max(dice) OVER p AS best, first(dy) OVER (PARTITION BY batch, page, k, row_a, row_b ORDER BY dice DESC, dy) AS best_dy FROM e WINDOW p AS (PARTITION BY batch, page, k, row_a, row_b)),
h AS (SELECT batch, page, k, row_a, row_b, any_value(best) AS best, max(greatest_aside) AS aside FROM (
  SELECT *, (SELECT max(2.0::DOUBLE * list_sum(list_transform(generate_series(0, 15), lambda y: CASE WHEN y - dy BETWEEN 0 AND 15 THEN bit_count(am[y + 1] & (CASE WHEN s > 0 THEN (bm[y - dy + 1] << greatest(s, 0)) & 4294967295 ELSE bm[y - dy + 1] >> greatest(-s, 0) END)) ELSE 0 END)) / total) FROM (SELECT unnest([-4, -2, -1, 1, 2, 4]) AS s)) AS greatest_aside
  FROM f WHERE abs(dy - best_dy) <= 1) GROUP BY ALL),
pix AS (SELECT c.batch, c.page, c.k, c.row_a, c.row_b, c.shape, CASE WHEN h.best IS NULL THEN 0.0::DOUBLE WHEN h.best < 0.53 THEN h.best ELSE greatest(h.best, h.aside) END AS pixel FROM c LEFT JOIN h USING (batch, page, k, row_a, row_b)),
opt AS (SELECT batch, page, k, round(avg(pixel), 9) AS mean, min(pixel) AS least, max(pixel) AS widest, round(avg(shape), 9) AS shape_mean, min(shape) AS shape_least FROM pix GROUP BY ALL)
"""


def masked_pages(spark, sf_dir):
    """Pages of rows: batch, page, row, payload (mask, u, fade)."""
    from rowloom.operators import masks

    vec = F.col("vec_id")
    batch = vec % 23
    overlap = F.element_at(F.array(F.lit(4), F.lit(1), F.lit(2)), (batch % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", batch.alias("batch"), (11 - overlap).alias("step"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), numbers.centred(F.col("embedding")).alias("u"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("batch").orderBy("vec_id")))
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - 11) / F.col("step")))
    rows = rows.withColumn("page", F.explode(F.sequence(first, F.floor((F.col("n") - 1) / F.col("step")))))
    nth = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    rows = rows.withColumns({"dx": nth((0, 2, -1, 1), F.col("page") % 4), "dy": nth((-1, 0, 1), F.col("page") % 3)})
    kind = F.col("page") % 5

    def bit(x, y):
        kept = F.when(kind == 1, (x + y) % 7 > 0).when(kind == 2, x % 2 == 0).when(kind == 3, (x + 2 * y) % 5 > 1).otherwise(True)
        return (F.get("v", ((F.floor((x - F.col("dx") + 640) / 4) + 5 * (y - F.col("dy")) + 640) % 64).cast("int")) > 0.06) & kept

    mask = F.transform(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), lambda y: masks.pack(F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda x: bit(x, y))))
    rows = rows.withColumn("mask", mask).withColumn("mask", masks.unless_blank(F.col("mask"), WIDTH, HEIGHT))
    return rows.select("batch", "page", (F.col("n") - F.col("page") * F.col("step")).cast("int").alias("row"), F.struct("mask", "u", ((F.col("page") * 3 + F.col("batch")) % 6).alias("fade")).alias("payload"))


def mask_options(spark, sf_dir):
    from rowloom.operators import masks, stitch

    a, b = F.col("a.payload"), F.col("b.payload")
    shape = F.greatest(F.lit(0.0), F.round(numbers.dot(a["u"], b["u"]) * (1 - a["fade"] * 0.06), 6))
    return masks.edge_options(stitch.row_pairs(masked_pages(spark, sf_dir), 11), masks.shift_likeness(a["mask"], b["mask"], WIDTH), shape)


@query("shifted_likeness", f"WITH {MASKS_SQL} SELECT batch, page, k, mean, round(least, 9) AS least, round(widest, 9) AS widest FROM opt")
def shifted_likeness(spark, sf_dir):
    """How alike the rows of neighbouring pages are by their masks at the best of the small shifts, for each k."""
    return mask_options(spark, sf_dir).select("batch", "page", "k", "mean", F.round("least", 9).alias("least"), F.round("widest", 9).alias("widest"))


@query(
    "overlap_edges",
    f"""
WITH {MASKS_SQL},
p AS (SELECT * FROM opt WHERE CASE WHEN k = 1 THEN mean >= 0.89 ELSE mean >= 0.77 AND least >= 0.72 END QUALIFY row_number() OVER (PARTITION BY batch, page ORDER BY mean + least(0.025, k * 0.004) DESC, k DESC) = 1),
q AS (SELECT *, row_number() OVER o AS place, lead(shape_mean) OVER o AS next FROM opt WHERE CASE WHEN k = 1 THEN shape_mean >= 0.745 ELSE shape_mean >= 0.67 AND shape_least >= 0.58 END WINDOW o AS (PARTITION BY batch, page ORDER BY shape_mean DESC, k DESC)),
x AS (SELECT batch, page, max(CASE WHEN k = 1 THEN mean END) AS direct, coalesce(max(CASE WHEN k = 2 THEN widest END), 0) AS near FROM opt GROUP BY ALL),
v AS (SELECT p.batch, p.page, max(o.mean) AS rival FROM p JOIN opt o ON o.batch = p.batch AND o.page = p.page AND o.k <> p.k AND o.mean >= 0.65 GROUP BY ALL),
w AS (SELECT x.batch, x.page, direct, near, p.k AS pk, p.mean AS pm, p.least AS pl, q.k AS sk, q.shape_mean AS sm, q.shape_least AS sl, q.mean AS sp, coalesce(round(sm - coalesce(q.next, 0), 9) >= 0.06 OR sm >= 0.90, false) AS ahead, rival IS NULL OR round(p.mean - rival, 9) >= 0.055 AS clear
      FROM x LEFT JOIN p USING (batch, page) LEFT JOIN q ON q.batch = x.batch AND q.page = x.page AND q.place = 1 LEFT JOIN v ON v.batch = x.batch AND v.page = x.page),
y AS (SELECT *, coalesce(CASE WHEN pk = 1 THEN pm >= 0.925 WHEN pk >= 4 THEN true ELSE pm >= 0.805 AND pl >= 0.75 END AND (clear OR pm >= 0.94), false) AS decisive, sm >= 0.81 AND sl >= 0.76 AS alone, sk = 1 AND sm >= 0.76 AND direct >= 0.79 AND round(direct - near, 9) >= 0.055 AS single, sk >= 2 AND sm >= 0.70 AND sl >= 0.60 AND sp >= 0.68 AS several FROM w)
SELECT batch, page, CAST(CASE WHEN decisive THEN pk ELSE sk END AS INTEGER) AS k, CASE WHEN decisive THEN pm ELSE sm END AS mean, round(CASE WHEN decisive THEN pl ELSE sl END, 9) AS least, CASE WHEN decisive THEN 'pixel' WHEN alone THEN 'alone' WHEN single THEN 'single' ELSE 'several' END AS rule, CASE WHEN decisive THEN 'pixel' ELSE 'shape+pixel' END AS method
FROM y WHERE decisive OR (ahead AND (pk IS NULL OR clear) AND (alone OR single OR several))
""",
)
def overlap_edges(spark, sf_dir):
    """Overlaps by pixels where those decide, else by shapes that one of three rules trusts."""
    from rowloom.operators import masks

    return masks.decide_edges(mask_options(spark, sf_dir)).withColumn("least", F.round("least", 9))
