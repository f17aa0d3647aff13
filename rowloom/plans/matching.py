"""Queries of ingest, stitching, matching and tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import numbers, text
from rowloom.operators import match, stitch, tiers, vectors
from rowloom.plans.registry import query
from rowloom.plans.search import SIGNS, table
from rowloom.sources import ingest
from rowloom.streaming import ingest as streams

# ---- ingest


@query(
    "link_extract",
    r"""
SELECT page_id, url, CAST(i - 1 AS INTEGER) AS item, hrefs[i] AS href, labels[i] AS label FROM (
  SELECT page_id, url, regexp_extract_all(html, p, 1) AS hrefs, regexp_extract_all(html, p, 2) AS labels, unnest(generate_series(1, len(regexp_extract_all(html, p)))) AS i
  FROM pages, (SELECT '<li>\s*<a\s+href="([^"]*)"[^>]*>([^<]*)</a>' AS p))
""",
)
def link_extract(spark, sf_dir):
    return ingest.links(table(spark, sf_dir, "pages"))


@query(
    "source_union",
    """
SELECT _slug, count(*) AS n, count(c_mktsegment) AS with_segment FROM (
  SELECT 'customer' AS _slug, c_name AS name, c_mktsegment FROM customer UNION ALL SELECT 'supplier', s_name, NULL FROM supplier UNION ALL SELECT 'part', p_name, NULL FROM part)
GROUP BY _slug
""",
)
def source_union(spark, sf_dir):
    parts = {
        "customer": table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_mktsegment"),
        "supplier": table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")),
        "part": table(spark, sf_dir, "part").select(F.col("p_name").alias("name")),
    }
    return ingest.union_sources(parts).groupBy("_slug").agg(F.count("*").alias("n"), F.count("c_mktsegment").alias("with_segment"))


@query("validate_roster", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE p_name IS NULL OR trim(p_name) = '') AS unnamed, count(*) FILTER (WHERE p_brand IS NULL OR trim(p_brand) = '') AS unsourced, count(DISTINCT p_brand) AS sources FROM part")
def validate_roster(spark, sf_dir):
    return ingest.audit(table(spark, sf_dir, "part"), F.col("p_name"), F.col("p_brand"))


@query("ingest_dedup", "SELECT event_id, user_id, event_type, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) = 1")
def ingest_dedup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    return ingest.dedup_events(events, ["user_id", "event_type", "props"], "event_id")


@query("stream_ingest", "SELECT DISTINCT user_id, event_type, props FROM events")
def stream_ingest(spark, sf_dir):
    """The same dedup as a stream over the files; which row of an identity comes first doesn't show."""
    return streams.ingest(spark, sf_dir, "events.parquet", ["user_id", "event_type", "props"])


# ---- stitching


def event_pages(spark, sf_dir) -> DataFrame:
    """Each user's events in order, shown in pages of 11 rows that start every 7 rows."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))
    low = F.greatest(F.lit(0), F.floor((F.col("n") - 12) / 7) + 1)
    pages = events.withColumn("page", F.explode(F.sequence(low, F.floor((F.col("n") - 1) / 7))))
    return pages.select(F.col("user_id").alias("batch"), "page", (F.col("n") - F.col("page") * 7).cast("int").alias("row"), F.col("event_id").alias("payload"))


def same_payload():
    return F.when(F.col("a.payload") == F.col("b.payload"), 1.0).otherwise(0.0)


PAGES_SQL = """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT user_id, event_id, n, CAST(greatest(0, floor((n - 12) / 7.0) + 1) AS BIGINT) AS lo, CAST(floor((n - 1) / 7.0) AS BIGINT) AS hi FROM e)
"""


@query("stitch_pages", PAGES_SQL + "SELECT user_id AS batch, n AS position, hi - lo + 1 AS copies, lo AS page, CAST(n - lo * 7 AS INTEGER) AS row, event_id AS payload FROM p")
def stitch_pages(spark, sf_dir):
    """Overlapping pages put together again; the overlap of four rows is found, not given."""
    return stitch.stitch(event_pages(spark, sf_dir), same_payload())


@query(
    "stitch_best_copy",
    PAGES_SQL
    + """, c AS (SELECT user_id, n, event_id, page, CASE WHEN page % 3 = 1 THEN 1000000000 ELSE 0 END + (event_id * 7 + page * 31) % 100 AS quality FROM (SELECT *, unnest(generate_series(lo, hi)) AS page FROM p))
SELECT user_id AS batch, n AS position, count(*) OVER (PARTITION BY user_id, n) AS copies, page, CAST(n - page * 7 AS INTEGER) AS row, event_id AS payload FROM c QUALIFY row_number() OVER (PARTITION BY user_id, n ORDER BY quality DESC, page) = 1
""",
)
def stitch_best_copy(spark, sf_dir):
    """Of a row's copies the one on a page with a valid header, then the largest."""
    quality = F.when(F.col("page") % 3 == 1, 1_000_000_000).otherwise(0) + (F.col("payload") * 7 + F.col("page") * 31) % 100
    return stitch.stitch(event_pages(spark, sf_dir), same_payload(), quality)


@query("batch_isolation", PAGES_SQL + "SELECT b || '__' || user_id AS batch, n AS position, event_id AS payload FROM p, (SELECT unnest(['x', 'y']) AS b)")
def batch_isolation(spark, sf_dir):
    """Two archives with the same pages stay apart."""
    names = event_pages(spark, sf_dir).withColumn("file", F.explode(F.array(F.lit("x"), F.lit("y")))).withColumn("batch", F.concat_ws("__", text.batch_of(F.concat("file", F.lit("__page.png"))), "batch")).drop("file")
    return stitch.stitch(names, same_payload()).select("batch", "position", "payload")


@query("overlap_options", PAGES_SQL + ", g AS (SELECT user_id, page, count(*) AS size FROM (SELECT user_id, unnest(generate_series(lo, hi)) AS page FROM p) GROUP BY ALL) SELECT user_id AS batch, page, CAST(least(4, next) AS INTEGER) AS k FROM (SELECT *, lead(size) OVER (PARTITION BY user_id ORDER BY page) AS next FROM g) WHERE next IS NOT NULL")
def overlap_options(spark, sf_dir):
    rows = event_pages(spark, sf_dir)
    return stitch.accepted_overlaps(stitch.overlap_options(rows, same_payload())).select("batch", "page", "k")


# ---- matching


def unit_vectors(spark, sf_dir, first: int = 1, n: int = 64) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    name = F.when(F.col("vec_id") % 5 == 0, F.col("vec_id") + 1).otherwise(F.col("vec_id"))
    return rows.select("vec_id", "label", name.alias("name"), numbers.centred(F.slice("embedding", first, n)).alias("u"))


def candidates(spark, sf_dir, first: int = 1, n: int = 64, top: int = 5) -> DataFrame:
    """The best rows for every row whose id divides by 20, by centred cosine over a slice of the vector."""
    rows = unit_vectors(spark, sf_dir, first, n)
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("u").alias("q"))
    others = rows.select(F.col("vec_id").alias("uid"), "label", "name", "u")
    return match.with_margin(vectors.best_by_product(asked, others, ("q", "u"), top=top, own=-2.0))


def candidates_sql(first: int = 1, n: int = 64, top: int = 5, name: str = "c") -> str:
    """Common table expressions that end with ``name``: query_id, query_label, uid, label, name, score, place, margin."""
    return f"""
{name}0 AS (SELECT vec_id, label, CASE WHEN vec_id % 5 = 0 THEN vec_id + 1 ELSE vec_id END AS name, list_transform(embedding[{first}:{first + n - 1}], lambda x: x::DOUBLE) AS e FROM embeddings),
{name}1 AS (SELECT *, list_transform(e, lambda x: x - list_sum(e) / {n}) AS m FROM {name}0),
{name}2 AS (SELECT vec_id, label, name, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m) + 1e-8)) AS u FROM {name}1),
{name}3 AS (SELECT q.vec_id AS query_id, q.label AS query_label, r.vec_id AS uid, r.label, r.name, CASE WHEN q.vec_id = r.vec_id THEN -2.0::DOUBLE ELSE round(list_inner_product(q.u, r.u), 6) END AS score FROM {name}2 q, {name}2 r WHERE q.vec_id % 20 = 0),
{name}4 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS INTEGER) AS place FROM {name}3 QUALIFY place <= {top}),
{name} AS (SELECT *, max(CASE WHEN place = 1 THEN score END) OVER (PARTITION BY query_id) - coalesce(max(CASE WHEN place = 2 THEN score END) OVER (PARTITION BY query_id), -9.0::DOUBLE) AS margin FROM {name}4)"""


NAMES_SQL = "s AS (SELECT name, count(*) AS same_name FROM c0 GROUP BY name)"


def best(spark, sf_dir, **slices) -> DataFrame:
    """Each query's best candidate with the second's score and the number of rows of its name."""
    found = candidates(spark, sf_dir, **slices)
    second = F.max(F.when(F.col("place") == 2, F.col("score")))
    per = found.groupBy("query_id", "query_label").agg(F.max_by(F.struct("uid", "label", "name", "score", "margin"), -F.col("place")).alias("b"), second.alias("second"))
    names = match.name_counts(unit_vectors(spark, sf_dir).select("name"), "name")
    return per.select("query_id", "query_label", "b.*", "second").join(names, "name")


@query("vector_topk_margin", f"WITH {candidates_sql()} SELECT query_id, uid, place, score, round(margin, 6) AS margin FROM c")
def vector_topk_margin(spark, sf_dir):
    return candidates(spark, sf_dir).select("query_id", "uid", "place", "score", F.round("margin", 6).alias("margin"))


@query("gated_pool", "WITH g AS (SELECT label, count(*) AS pool FROM embeddings GROUP BY label) SELECT vec_id, label, pool, CASE WHEN pool > 50 THEN label END AS gate FROM embeddings JOIN g USING (label) WHERE vec_id % 20 = 0")
def gated_pool(spark, sf_dir):
    """Queries keep their label as a gate only where over 50 rows have it."""
    rows = table(spark, sf_dir, "embeddings")
    return match.gated_pool(rows.filter("vec_id % 20 = 0").select("vec_id", "label"), rows, "label", least=50).select("vec_id", "label", "pool", "gate")


MODE_SQL = "CASE query_id // 20 % 4 WHEN 0 THEN 'flat' WHEN 1 THEN 'recovery' WHEN 2 THEN 'strong' ELSE 'plain' END"


@query(
    "match_accept",
    f"""
WITH {candidates_sql()}, {NAMES_SQL}
SELECT query_id, uid, {MODE_SQL} AS mode, same_name = 1 AND CASE {MODE_SQL}
  WHEN 'flat' THEN score >= 0.78 AND margin >= 0.22 AND score - 0.01 >= 0.75 WHEN 'recovery' THEN score >= 0.73 AND margin >= 0.18 AND score - 0.01 >= 0.69
  WHEN 'strong' THEN score >= 0.60 AND margin >= 0.14 ELSE score >= 0.65 AND margin >= 0.15 AND score - 0.01 >= 0.55 END AS accepted
FROM c JOIN s USING (name) WHERE place = 1
""",
)
def match_accept(spark, sf_dir):
    turn = F.floor(F.col("query_id") / 20) % 4
    mode = F.when(turn == 0, "flat").when(turn == 1, "recovery").when(turn == 2, "strong").otherwise("plain")
    rows = best(spark, sf_dir).withColumn("mode", mode)
    return rows.select("query_id", "uid", "mode", match.accept(F.col("score"), F.col("margin"), F.col("score") - 0.01, F.col("same_name"), F.col("mode")).alias("accepted"))


POSITION = ("投手", "捕手", "一壘手", "外野手")
CATEGORY = ("", "投手", "捕手", "內野手", "外野手")


def _nth(values: tuple[str, ...], n):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


@query(
    "tentative_tier",
    f"""
WITH {candidates_sql()}, {NAMES_SQL},
b AS (SELECT a.query_id, a.uid, a.score, z.score AS second, same_name, ['', '投手', '捕手', '內野手', '外野手'][a.query_label % 5 + 1] AS category, ['投手', '捕手', '一壘手', '外野手'][a.label % 4 + 1] AS position
      FROM c a LEFT JOIN c z ON a.query_id = z.query_id AND z.place = 2 JOIN s ON a.name = s.name WHERE a.place = 1),
f AS (SELECT *, CASE category WHEN '內野手' THEN position = '一壘手' WHEN '' THEN false ELSE position = category END AS fits FROM b)
SELECT query_id, uid, category, position, coalesce(second IS NOT NULL AND same_name = 1 AND (category = '' OR fits) AND
  ((score >= 0.57 AND score - second >= 0.075) OR (category <> '' AND fits AND score >= 0.55 AND score - second >= 0.048) OR (score >= 0.65 AND score - second >= 0.035)), false) AS tentative FROM f
""",
)
def tentative_tier(spark, sf_dir):
    rows = best(spark, sf_dir).withColumns({"category": _nth(CATEGORY, F.col("query_label")), "position": _nth(POSITION, F.col("label"))})
    fits = match.fits_category(F.col("category"), F.col("position"))
    found = match.tentative(F.col("score"), F.col("second"), F.lit(None).cast("double"), F.col("same_name"), F.col("category"), fits)
    return rows.select("query_id", "uid", "category", "position", found.alias("tentative"))


HALVES_SQL = f"WITH {candidates_sql(1, 32, name='p')}, {candidates_sql(33, 32, name='a')}, {candidates_sql()}, {NAMES_SQL}, "


def halves(spark, sf_dir) -> DataFrame:
    """The best candidates by the first and by the second half of the vector, side by side with the whole vector's."""

    def one(found: DataFrame, name: str) -> DataFrame:
        accepted = match.accept(F.col("score"), F.col("margin"), F.col("score"), F.col("same_name"), F.lit("plain"))
        return found.select("query_id", F.struct("uid", "score", "margin", accepted.alias("matched"), "same_name").alias(name))

    return one(best(spark, sf_dir, first=1, n=32), "p").join(one(best(spark, sf_dir, first=33, n=32), "a"), "query_id").join(one(best(spark, sf_dir), "base"), "query_id")


MATCHED_SQL = "same_name = 1 AND score >= 0.65 AND margin >= 0.15"
SIDES_SQL = ", ".join(f"{x}b AS (SELECT query_id, uid, score, margin, same_name, {MATCHED_SQL} AS matched FROM {x} JOIN s USING (name) WHERE place = 1)" for x in "pac")


@query(
    "crop_reconcile",
    HALVES_SQL
    + SIDES_SQL
    + """
SELECT p.query_id, p.uid AS primary_uid, a.uid AS alternate_uid, CASE WHEN p.matched OR p.uid <> a.uid THEN 'primary' WHEN a.matched AND a.score >= p.score - 0.04 THEN 'alternate'
  WHEN p.score >= 0.67 AND a.score >= 0.67 AND p.margin >= 0.10 AND a.margin >= 0.10 AND p.same_name = 1 THEN 'promoted' ELSE 'primary' END AS trusted
FROM pb p JOIN ab a USING (query_id)
""",
)
def crop_reconcile(spark, sf_dir):
    rows = halves(spark, sf_dir)
    return rows.select("query_id", F.col("p.uid").alias("primary_uid"), F.col("a.uid").alias("alternate_uid"), match.reconcile(F.col("p"), F.col("a"), F.col("p.same_name")).alias("trusted"))


@query(
    "flat_corroborate",
    HALVES_SQL
    + SIDES_SQL
    + """
SELECT p.query_id, CASE WHEN p.uid = a.uid AND p.same_name = 1 AND NOT b.matched AND p.matched AND a.matched AND abs(p.score - a.score) <= 0.12 THEN 'confirmed'
  WHEN p.uid = a.uid AND p.same_name = 1 AND NOT b.matched AND least(p.score, a.score) >= 0.66 AND b.score < least(p.score, a.score) - 0.06 THEN 'candidate' ELSE 'unchanged' END AS outcome
FROM pb p JOIN ab a USING (query_id) JOIN cb b USING (query_id)
""",
)
def flat_corroborate(spark, sf_dir):
    rows = halves(spark, sf_dir)
    return rows.select("query_id", match.corroborate(F.col("base"), F.col("p"), F.col("a"), F.col("p.same_name"), F.lit(True)).alias("outcome"))


QUARTERS_SQL = "WITH " + ", ".join(candidates_sql(1 + 16 * i, 16, name=f"q{i}") for i in range(4)) + ", c0 AS (SELECT * FROM q00), " + NAMES_SQL


@query(
    "consensus_vote",
    QUARTERS_SQL
    + ", t AS ("
    + " UNION ALL ".join(f"SELECT query_id AS row, {i} AS attempt, place, uid, score FROM q{i}" for i in range(4))
    + """),
x AS (SELECT row, attempt, min(score) - 0.12 AS stand_in, max(score) AS lead, arg_min(uid, place) AS lead_uid FROM t GROUP BY ALL),
b AS (SELECT row, arg_max({'uid': lead_uid, 'score': lead, 'attempt': attempt, 'matched': lead >= 0.8}, lead - attempt * 1e-9) AS best FROM x GROUP BY row),
u AS (SELECT row, uid, count(*) FILTER (WHERE place = 1) AS votes, arg_max(attempt, score - attempt * 1e-9) FILTER (WHERE place = 1) AS supporting FROM t GROUP BY ALL),
m AS (SELECT u.row, u.uid, any_value(u.votes) AS votes, any_value(u.supporting) AS supporting, count(*) AS attempts, round(avg(coalesce(t.score, x.stand_in)), 8) AS score FROM u JOIN x ON u.row = x.row LEFT JOIN t ON t.row = u.row AND t.attempt = x.attempt AND t.uid = u.uid GROUP BY u.row, u.uid),
r AS (SELECT *, row_number() OVER w AS n, round(score - coalesce(lead(score) OVER w, -9), 8) AS gap FROM m WINDOW w AS (PARTITION BY row ORDER BY score DESC, uid)),
o AS (SELECT r.*, best, NOT best.matched AND votes >= 3 AND score >= 0.66 AND gap >= 0.145 AND same_name = 1 AS accepted FROM r JOIN s ON s.name = CASE WHEN r.uid % 5 = 0 THEN r.uid + 1 ELSE r.uid END JOIN b USING (row) WHERE n = 1)
SELECT row, votes, attempts, score, gap, accepted, CASE WHEN accepted THEN supporting ELSE best.attempt END AS attempt, CASE WHEN accepted THEN uid ELSE best.uid END AS chosen_uid, CASE WHEN accepted THEN score ELSE best.score END AS chosen_score FROM o
""",
)
def consensus_vote(spark, sf_dir):
    """Four quarters of the vector as attempts to read a row."""
    attempts = [candidates(spark, sf_dir, first=1 + 16 * i, n=16).select(F.col("query_id").alias("row"), F.lit(i).alias("attempt"), "place", "uid", "score", ((F.col("place") == 1) & (F.col("score") >= 0.8)).alias("matched")) for i in range(4)]
    rows = unit_vectors(spark, sf_dir).select(F.col("vec_id").alias("uid"), "name")
    names = rows.join(match.name_counts(rows, "name"), "name").select("uid", "same_name")
    found = match.consensus(reduce(DataFrame.union, attempts), names)
    return found.select("row", "votes", "attempts", "score", F.round("gap", 8).alias("gap"), "accepted", "attempt", "chosen_uid", "chosen_score")


def name_pairs_sql(similarity: str, least: float) -> str:
    return f"""
WITH k AS (SELECT DISTINCT regexp_replace(lower(p_name || p_type), '{SIGNS}', '', 'g') AS k FROM part),
p AS (SELECT a.k AS a, b.k AS b FROM k a JOIN k b ON a.k < b.k)
SELECT a AS name_a, b AS name_b, round({similarity}, 6) AS similarity FROM p WHERE {similarity} >= {least}
"""


LIKE_SQL = "greatest(0.0::DOUBLE, (1 - levenshtein(a, b)::DOUBLE / greatest(len(a), len(b))) * 0.72::DOUBLE + (2 * list_sum(list_transform(list_distinct(string_split(a, '')), lambda c: least(len(a) - len(replace(a, c, '')), len(b) - len(replace(b, c, '')))))::DOUBLE / (len(a) + len(b))) * 0.28::DOUBLE)"
DICE_SQL = "(2.0 * len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, ''))))::DOUBLE / (len(list_distinct(string_split(a, ''))) + len(list_distinct(string_split(b, '')))))"


def named_parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat("p_name", "p_type").alias("name"))


@query("fuzzy_name_match", name_pairs_sql(LIKE_SQL, 0.7))
def fuzzy_name_match(spark, sf_dir):
    found = match.alike_names(named_parts(spark, sf_dir), text.name_key(F.col("name")), 0.7)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("dice_similarity", name_pairs_sql(DICE_SQL, 0.8))
def dice_similarity(spark, sf_dir):
    found = match.dice_names(named_parts(spark, sf_dir), text.name_key(F.col("name")), 0.8)
    return found.withColumn("similarity", F.round("similarity", 6))


# ---- tiers


@query("mode_tiebreak", "SELECT l_returnflag, q, n FROM (SELECT l_returnflag, CAST(l_quantity AS INTEGER) AS q, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 20 AND 200 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, q DESC) = 1")
def mode_tiebreak(spark, sf_dir):
    return tiers.mode_in_range(table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("q")), "q", ["l_returnflag"])


def evidence(spark, sf_dir) -> DataFrame:
    """Events as result rows: their type is the batch, the user is who was recognised, the value is the evidence."""
    score = F.round(F.col("value") / (F.col("value") + 10), 6)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("batch"), F.col("event_id").alias("first_index"), score.alias("score"), "user_id")
    seen = F.col("score") >= 0.5
    return rows.withColumns({
        "match": F.when((F.col("score") >= 0.8) & (F.col("first_index") % 7 == 0), F.col("user_id")),
        "resolved": F.when((F.col("score") < 0.8) & seen, F.col("user_id")),
        "status": F.when((F.col("score") >= 0.8) & (F.col("first_index") % 7 == 0), "確認").otherwise("候選"),
    })


EVIDENCE_SQL = """
WITH e0 AS (SELECT event_type AS batch, event_id AS first_index, round(value / (value + 10), 6) AS score, user_id FROM events),
e AS (SELECT *, CASE WHEN score >= 0.8 AND first_index % 7 = 0 THEN user_id END AS match, CASE WHEN score < 0.8 AND score >= 0.5 THEN user_id END AS resolved FROM e0),
k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY CASE WHEN match IS NOT NULL THEN 3 WHEN resolved IS NOT NULL THEN 2 ELSE 1 END DESC, score DESC, first_index) AS n FROM e),
d AS (SELECT batch, first_index, score, user_id, resolved, CASE WHEN match IS NOT NULL AND count(match) OVER (PARTITION BY batch, CASE WHEN match IS NOT NULL THEN user_id % 60 END) > 1 THEN NULL ELSE match END AS match FROM k WHERE n <= 180),
f AS (SELECT batch, first_index, score, match, CASE WHEN resolved IS NOT NULL AND EXISTS (SELECT 1 FROM d x WHERE x.batch = d.batch AND x.match = d.resolved) THEN NULL ELSE resolved END AS resolved FROM d)
"""


@query("evidence_cap", EVIDENCE_SQL + "SELECT batch, first_index, match, resolved, score FROM k WHERE n <= 180")
def evidence_cap(spark, sf_dir):
    """The 180 strongest rows of each batch, the roster's size."""
    return tiers.cap(evidence(spark, sf_dir), F.lit(180), ["batch"]).select("batch", "first_index", "match", "resolved", "score")


@query("evidence_cap_global", EVIDENCE_SQL + "SELECT batch, first_index, score FROM e QUALIFY row_number() OVER (ORDER BY CASE WHEN match IS NOT NULL THEN 3 WHEN resolved IS NOT NULL THEN 2 ELSE 1 END DESC, score DESC, first_index) <= 150")
def evidence_cap_global(spark, sf_dir):
    """One cap over all batches, for parity; the rank limit is pushed below the single last task."""
    return tiers.cap(evidence(spark, sf_dir), F.lit(150), []).select("batch", "first_index", "score")


def _name():
    return F.concat(F.lit("n"), (F.col("user_id") % 60).cast("string"))


@query("collision_demotion", EVIDENCE_SQL + "SELECT batch, first_index, match FROM d")
def collision_demotion(spark, sf_dir):
    capped = tiers.cap(evidence(spark, sf_dir), F.lit(180), ["batch"])
    return tiers.demote_collisions(capped, "batch", _name()).select("batch", "first_index", "match")


@query("finished_tiers", EVIDENCE_SQL + "SELECT batch, first_index, match, resolved FROM f")
def finished_tiers(spark, sf_dir):
    done = tiers.finish(evidence(spark, sf_dir), "batch", _name(), F.lit(180), ["batch"])
    return done.select("batch", "first_index", "match", "resolved")


@query("tier_stats", EVIDENCE_SQL + "SELECT batch, CAST(sum(first_index % 3 + 1) AS BIGINT) AS raw, count(*) AS unique_rows, count(match) AS confirmed, count(*) FILTER (WHERE match IS NULL AND resolved IS NOT NULL) AS tentative, count(*) FILTER (WHERE match IS NULL AND resolved IS NULL) AS pending FROM f GROUP BY batch")
def tier_stats(spark, sf_dir):
    """Counts by batch; an event stands for one to three copies of a row."""
    done = tiers.finish(evidence(spark, sf_dir), "batch", _name(), F.lit(180), ["batch"])
    return tiers.statistics(done.withColumn("copies", F.col("first_index") % 3 + 1), "batch", raw="copies")


@query(
    "merge_evidence",
    """
SELECT conv_id, list_sort(list_distinct(list(role))) AS tags, arg_min(text, turn) FILTER (WHERE role = 'assistant' AND text <> '') AS first_value, max(CAST(len(text) AS INTEGER)) AS best, min(turn) AS first_index, count(*) AS n FROM conversations GROUP BY conv_id
""",
)
def merge_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumns({"said": F.when(F.col("role") == "assistant", F.col("text")).otherwise(""), "size": F.length("text")})
    return tiers.merge_evidence(rows, "conv_id", "turn", "said", "role", "size")


# ---- numbers


@query(
    "ink_luma",
    """
SELECT l_orderkey, l_linenumber, r, g, b, CAST(CASE WHEN b - r >= 10 AND b - g >= 10 AND r <= 110 AND g <= 110 AND b <= 118 THEN least(255, floor(76 + 4.8::DOUBLE * least(40.0::DOUBLE, b - (r + g)::DOUBLE / 2) + 0.5))
   ELSE floor(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE + 0.5) END AS INTEGER) AS luma
FROM (SELECT l_orderkey, l_linenumber, l_orderkey % 121 AS r, l_partkey % 121 AS g, l_suppkey * 7 % 130 AS b FROM lineitem)
""",
)
def ink_luma(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 121).alias("r"), (F.col("l_partkey") % 121).alias("g"), (F.col("l_suppkey") * 7 % 130).alias("b"))
    return rows.withColumn("luma", numbers.ink_luma(F.col("r"), F.col("g"), F.col("b")))


@query("ink_gate", "SELECT l_partkey, ink, CASE WHEN l_partkey % 13 > 11 THEN 'kept' WHEN ink >= 60 THEN 'name' WHEN ink >= 40 THEN 'uncertain' ELSE 'empty' END AS gate FROM (SELECT l_partkey, CAST(sum(l_linenumber) % 100 AS BIGINT) AS ink FROM lineitem GROUP BY 1)")
def ink_gate(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg((F.sum("l_linenumber") % 100).alias("ink"))
    return sums.withColumn("gate", numbers.ink_gate(F.col("ink"), F.col("l_partkey") % 13 <= 11))


@query("median_threshold", "SELECT l_shipyear, CAST(quantile_disc(q, 0.5) AS INTEGER) AS median, count(*) FILTER (WHERE q > 25) AS above FROM (SELECT year(l_shipdate)::INTEGER AS l_shipyear, l_quantity::INTEGER AS q FROM lineitem) GROUP BY 1")
def median_threshold(spark, sf_dir):
    """The value at which a histogram reaches half of its rows, by a running sum over its bins."""
    from pyspark.sql import Window

    bins = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("l_shipyear"), F.col("l_quantity").cast("int").alias("q")).agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.partitionBy("l_shipyear").orderBy("q"))
    total = F.sum("n").over(Window.partitionBy("l_shipyear"))
    half = bins.withColumns({"run": run, "total": total})
    return half.groupBy("l_shipyear").agg(F.min(F.when(F.col("run") * 2 >= F.col("total"), F.col("q"))).alias("median"), F.sum(F.when(F.col("q") > 25, F.col("n")).otherwise(0)).alias("above"))


@query(
    "autocorr_pitch",
    """
WITH h AS (SELECT event_type, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS h, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT event_type, h, n - avg(n) OVER (PARTITION BY event_type) AS d FROM h),
l AS (SELECT a.event_type, lag, sum(a.d * b.d) / sqrt(sum(a.d * a.d) * sum(b.d * b.d) + 1e-8) AS c FROM m a, (SELECT unnest(generate_series(25, 55)) AS lag), m b WHERE a.event_type = b.event_type AND b.h = a.h + lag GROUP BY ALL)
SELECT event_type, CAST(lag AS INTEGER) AS lag, round(c, 6) AS correlation FROM l
""",
)
def autocorr_pitch(spark, sf_dir):
    """Normalised autocorrelation of hourly counts at each lag, the profile that a row pitch is read from."""
    from pyspark.sql import Window

    hours = table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("h")).agg(F.count("*").alias("n"))
    moved = hours.select("event_type", "h", (F.col("n") - F.avg("n").over(Window.partitionBy("event_type"))).alias("d"))
    later = moved.select(F.col("event_type").alias("t"), F.col("h").alias("h2"), F.col("d").alias("e"))
    lags = moved.withColumn("lag", F.explode(F.sequence(F.lit(25), F.lit(55))))
    pairs = lags.join(later, (F.col("event_type") == F.col("t")) & (F.col("h2") == F.col("h") + F.col("lag")))
    top = F.sum(F.col("d") * F.col("e")) / F.sqrt(F.sum(F.col("d") * F.col("d")) * F.sum(F.col("e") * F.col("e")) + 1e-8)
    return pairs.groupBy("event_type", "lag").agg(F.round(top, 6).alias("correlation"))
