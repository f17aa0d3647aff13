"""Queries of record search, sorting, comparison and the document corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.functions import sortkeys, text
from rowloom.operators import corpus, roster
from rowloom.operators.written import with_place
from rowloom.plans.registry import query

#: Ignored signs as a class for DuckDB's regular expressions.
SIGNS = r"[\s　・·･,，。./／()（）\-–—_:：;；''\"「」『』【】\[\]]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "norm_search",
    f"""
SELECT p_partkey, p_name, search_key FROM (
  SELECT p_partkey, p_name, regexp_replace(lower(concat_ws(' ', 'p_name', 'Part Name', p_name, 'p_brand', 'Brand', p_brand, 'p_type', 'Type', p_type, p_size::VARCHAR)), '{SIGNS}', '', 'g') AS search_key FROM part)
WHERE contains(search_key, 'ringpbrandbrandbrand#1')
""",
)
def norm_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    columns = {c: F.col(c) for c in ("p_name", "p_brand", "p_type")}
    key = text.search_column(columns, {"p_name": "Part Name", "p_brand": "Brand", "p_type": "Type"}, [F.col("p_size")])
    return roster.search(part.withColumn("search_key", key), "search_key", "Ring P_BRAND（Brand） Brand#1").select("p_partkey", "p_name", "search_key")


@query(
    "document_search",
    f"""
SELECT doc_id, lang, source FROM documents
WHERE contains(regexp_replace(lower(coalesce(text, '')), '{SIGNS}', '', 'g'), 'ofthethe') AND lang = 'en'
""",
)
def document_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("key", text.search_key(F.col("text")))
    return roster.search(docs, "key", "Of the, the", {"lang": "en", "source": ""}).select("doc_id", "lang", "source")


@query(
    "facet_filter",
    """
SELECT c_custkey, c_name, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment = 'MACHINERY' AND n_regionkey = 1 AND contains(lower(c_name), '7')
""",
)
def facet_filter(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    keyed = joined.withColumn("key", text.search_key(F.col("c_name")))
    return roster.search(keyed, "key", " 7 ", {"c_mktsegment": "MACHINERY", "n_regionkey": 1}).select("c_custkey", "c_name", "n_name", "c_acctbal")


@query(
    "split_sort_page",
    """
SELECT o_orderkey, is_open, o_orderpriority, o_totalprice, position, page, pages FROM (
  SELECT *, CAST((position - 1) // 40 + 1 AS INTEGER) AS page, CAST(ceil(n / 40.0) AS INTEGER) AS pages FROM (
    SELECT *, o_orderstatus = 'O' AS is_open, CAST(row_number() OVER (PARTITION BY o_orderstatus = 'O' ORDER BY left(o_orderpriority, 1), o_totalprice DESC, o_orderkey) AS INTEGER) AS position,
           count(*) OVER (PARTITION BY o_orderstatus = 'O') AS n FROM orders))
WHERE page = 3
""",
)
def split_sort_page(spark, sf_dir):
    """Orders split in open ones and others, by urgency, then price, then key: the third page of either."""
    orders = table(spark, sf_dir, "orders").withColumn("is_open", F.col("o_orderstatus") == "O")
    page = roster.fetch_page(orders, ["is_open"], [F.substring("o_orderpriority", 1, 1), F.col("o_totalprice").desc(), F.col("o_orderkey")], page=3)
    return page.select("o_orderkey", "is_open", "o_orderpriority", "o_totalprice", "position", "page", "pages")


@query(
    "grade_sort_key",
    """
WITH g AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN NULL WHEN 1 THEN '—' WHEN 2 THEN 'C/' || substr('SABCDEFG', p_size % 7 + 1, 1) || '+' WHEN 3 THEN substr('SABCDEFG', p_size % 8 + 1, 1)
             WHEN 4 THEN p_size::VARCHAR || 'km/h' WHEN 5 THEN p_size::VARCHAR WHEN 6 THEN 'SS' ELSE p_name END AS v FROM part),
p AS (SELECT *, CASE WHEN v IS NULL OR v = '—' THEN NULL ELSE trim(list_last(string_split(v, '/'))) END AS last FROM g),
k AS (SELECT p_partkey, v, v IS NULL OR v = '—' AS blank,
        coalesce(CAST(list_position(['G','F','E','E+','D','D+','C','C+','B','B+','A','A+','S','S+','SS'], last) AS DOUBLE), TRY_CAST(regexp_extract(v, '^(\\d+)(km/h)?$', 1) AS DOUBLE)) AS number FROM p)
SELECT p_partkey, v, blank, number, CASE WHEN NOT blank AND number IS NULL THEN lower(v) END AS text,
       CAST(row_number() OVER (ORDER BY blank, CASE WHEN NOT blank AND number IS NULL THEN lower(v) END DESC NULLS LAST, number DESC NULLS LAST, p_partkey) AS INTEGER) AS place
FROM k
""".replace("\\\\", "\\"),
)
def grade_sort_key(spark, sf_dir):
    """Grades, ranges, numbers with units, blanks and names in one column, sorted best first."""
    size = F.col("p_size")
    letter = lambda n: F.expr(f"substr('SABCDEFG', p_size % {n} + 1, 1)")
    value = (
        F.when(size % 8 == 1, "—")
        .when(size % 8 == 2, F.concat(F.lit("C/"), letter(7), F.lit("+")))
        .when(size % 8 == 3, letter(8))
        .when(size % 8 == 4, F.concat(size.cast("string"), F.lit("km/h")))
        .when(size % 8 == 5, size.cast("string"))
        .when(size % 8 == 6, "SS")
        .when(size % 8 == 7, F.col("p_name"))
    )
    keyed = table(spark, sf_dir, "part").select("p_partkey", value.alias("v")).withColumn("key", sortkeys.sort_key(F.col("v")))
    placed = with_place(keyed, sortkeys.ordering("key", "p_partkey"))
    return placed.select("p_partkey", "v", "key.blank", "key.number", "key.text", F.col("place").cast("int").alias("place"))


@query(
    "natural_order",
    """
SELECT page_id, url, host_key, natural_key FROM (
  SELECT page_id, url, split_part(url, '/', 3) AS host_key, lower(url) AS u,
    array_to_string(list_transform(regexp_extract_all(lower(url), '(\\d+|[^\\d]+)'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(len(ltrim(left(p, len(p) - 1), '0') || right(p, 1))::VARCHAR, 10, '0') || ltrim(left(p, len(p) - 1), '0') || right(p, 1) ELSE p END), '') AS natural_key FROM pages)
""".replace("\\\\", "\\"),
)
def natural_order(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.split_part("url", F.lit("/"), F.lit(3)).alias("host_key"), sortkeys.natural_text(F.col("url")).alias("natural_key"))


@query(
    "detail_unpivot",
    """
SELECT c_custkey, attribute, value FROM (SELECT c_custkey, c_name::VARCHAR AS c_name, c_nationkey::VARCHAR AS c_nationkey, nullif(c_mktsegment, 'BUILDING')::VARCHAR AS c_mktsegment FROM customer)
UNPIVOT (value FOR attribute IN (c_name, c_nationkey, c_mktsegment)) WHERE value <> ''
""",
)
def detail_unpivot(spark, sf_dir):
    """All shown attributes of every customer as rows; blank ones are left out."""
    customer = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return roster.detail(customer, "c_custkey", skip=("c_acctbal",))


@query(
    "compare_pivot",
    "WITH c AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS slot FROM part QUALIFY slot <= 20), "
    + "l AS (SELECT slot, unnest(['p_name', 'p_brand', 'p_type', 'p_size']) AS attribute, unnest([p_name, p_brand, CASE WHEN p_type = 'PROMO' THEN '–' ELSE p_type END, p_size::VARCHAR]) AS value FROM c) "
    + "SELECT attribute, "
    + ", ".join(f"coalesce(nullif(max(CASE WHEN slot = {i} THEN value END), ''), '—') AS s{i}" for i in range(1, 21))
    + " FROM l GROUP BY attribute HAVING bool_or(value IS NOT NULL AND value NOT IN ('', '–'))",
)
def compare_pivot(spark, sf_dir):
    """The twenty dearest parts side by side; twenty is the comparison's limit."""
    part = table(spark, sf_dir, "part").withColumn("p_type", F.when(F.col("p_type") == "PROMO", "–").otherwise(F.col("p_type")))
    best = part.orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(20)
    slot = F.row_number().over(Window.orderBy(F.col("p_retailprice").desc(), "p_partkey"))
    chosen = best.select("p_partkey", slot.alias("slot"))
    return roster.compare(part.drop("p_retailprice"), chosen, "p_partkey")


@query(
    "name_fix_scoped",
    """
SELECT p_partkey, CASE WHEN fix THEN p_name || ' (old)' ELSE p_name END AS p_name, p_brand, p_type, CASE WHEN fix THEN p_name END AS name_orig
FROM (SELECT *, max(p_size) OVER (PARTITION BY p_name, p_brand, p_type) >= 48 AS fix FROM part)
""",
)
def name_fix_scoped(spark, sf_dir):
    """Names corrected only where name, brand and type match a correction; the corrections come from the parts of large size."""
    part = table(spark, sf_dir, "part")
    fixes = part.filter("p_size >= 48").select("p_name", "p_brand", "p_type", F.concat("p_name", F.lit(" (old)")).alias("new_name")).distinct()
    fixed = roster.correct_names(part, fixes, "p_name", ["p_brand", "p_type"])
    return fixed.select("p_partkey", "p_name", "p_brand", "p_type", F.col("_name_orig").alias("name_orig"))


@query("roster_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal < 0) AS special, count(*) FILTER (WHERE NOT c_acctbal < 0) AS other FROM customer")
def roster_counts(spark, sf_dir):
    return roster.counts(table(spark, sf_dir, "customer"), F.col("c_acctbal") < 0)


def sections(spark, sf_dir) -> DataFrame:
    """Documents as sections of a book: a source is a chapter, lines are the items, the first line's start is the title."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select(F.col("source").alias("chapter"), F.col("doc_id").alias("section"), F.substring("text", 1, 12).alias("title"), F.lit(None).cast("array<array<string>>").alias("rows"), F.split("text", "\n", -1).alias("items"))


ROUTE_SQL = """
SELECT source AS chapter_id, doc_id AS section, source || ':' || doc_id::VARCHAR AS reading_id,
  CASE WHEN doc_id % 97 = 5 THEN 'override' WHEN source LIKE '%9' THEN 'archive' ELSE 'topic' || (CAST(substr(source, 4) AS INTEGER) % 7)::VARCHAR END AS place,
  CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS entries
FROM documents
"""


def routed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = sections(spark, sf_dir).select(F.col("chapter").alias("chapter_id"), "section", "rows", "items")
    names = found.select("chapter_id").distinct()
    routes = names.select("chapter_id", F.concat(F.lit("topic"), (F.substring("chapter_id", 4, 9).cast("int") % 7).cast("string")).alias("place"))
    overrides = found.filter("section % 97 = 5").select("chapter_id", "section", F.lit("override").alias("place"))
    return found, corpus.route(found, routes, overrides, names.filter(F.col("chapter_id").endswith("9")))


@query("route_corpus", ROUTE_SQL)
def route_corpus(spark, sf_dir):
    _, placed = routed(spark, sf_dir)
    return placed.select("chapter_id", "section", "reading_id", "place", corpus.entry_count(F.col("rows"), F.col("items")).alias("entries"))


#: The routed sections with planted defects: some lost, some doubled, some without a place.
SPOILT_SQL = f"""
WITH a AS ({ROUTE_SQL}), b AS (SELECT reading_id, chapter_id, section, CASE WHEN section % 53 = 1 THEN NULL ELSE place END AS place FROM a WHERE section % 31 <> 2),
s AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE section % 41 = 3)
"""


def spoilt(placed: DataFrame) -> DataFrame:
    kept = placed.filter("section % 31 <> 2").withColumn("place", F.when(F.col("section") % 53 != 1, F.col("place")))
    return kept.union(kept.filter("section % 41 = 3"))


@query(
    "routing_checks",
    SPOILT_SQL
    + """
SELECT (SELECT count(*) FROM (SELECT reading_id FROM a EXCEPT ALL SELECT reading_id FROM s)) AS lost, (SELECT count(*) FROM (SELECT reading_id FROM s GROUP BY 1 HAVING count(*) > 1)) AS doubled,
  (SELECT count(*) FROM s WHERE place IS NULL) AS unplaced
""",
)
def routing_checks(spark, sf_dir):
    """What the checks find in a routing with planted defects."""
    found, placed = routed(spark, sf_dir)
    return corpus.check_routing(found, spoilt(placed))


@query(
    "route_checks",
    SPOILT_SQL
    + """
, t AS (SELECT 'topic' || i AS place FROM (SELECT unnest(generate_series(0, 7)) AS i) UNION ALL SELECT 'override'),
c AS (SELECT DISTINCT chapter_id FROM a), r AS (SELECT chapter_id FROM c UNION ALL SELECT chapter_id FROM c WHERE chapter_id LIKE '%3'),
z AS (SELECT CASE WHEN s.section % 43 = 7 AND s.place <> 'archive' THEN 'nowhere' ELSE s.place END AS place, entries FROM s JOIN a USING (reading_id))
SELECT (SELECT count(*) FROM (SELECT chapter_id FROM r GROUP BY 1 HAVING count(*) > 1)) AS double_routes, (SELECT count(*) FROM z WHERE place <> 'archive' AND place NOT IN (SELECT place FROM t)) AS bad_places,
  (SELECT count(*) FROM t WHERE coalesce((SELECT sum(entries) FROM z WHERE z.place = t.place), 0) = 0) AS empty_places
""",
)
def route_checks(spark, sf_dir):
    """Routes with planted defects: chapters routed twice, sections sent nowhere, and a place that nothing reaches."""
    found, placed = routed(spark, sf_dir)
    names = found.select("chapter_id").distinct()
    routes = names.unionByName(names.filter(F.col("chapter_id").endswith("3"))).withColumn("place", F.lit("topic0"))
    rows = spoilt(placed).withColumn("entries", corpus.entry_count(F.col("rows"), F.col("items")))
    off = (F.col("section") % 43 == 7) & (F.col("place") != "archive")
    places = spark.range(8).select(F.concat(F.lit("topic"), F.col("id").cast("string")).alias("place")).unionByName(names.select(F.lit("override").alias("place")).distinct())
    return corpus.check_routes(routes, rows.withColumn("place", F.when(off, "nowhere").otherwise(F.col("place"))), places)


@query("chapter_counts", f"SELECT place, count(*) AS sections, CAST(sum(entries) AS BIGINT) AS entries FROM ({ROUTE_SQL}) GROUP BY place")
def chapter_counts(spark, sf_dir):
    return route_corpus(spark, sf_dir).groupBy("place").agg(F.count("*").alias("sections"), F.sum("entries").alias("entries"))


@query(
    "row_search",
    f"""
WITH l AS (SELECT source AS chapter, doc_id AS section, substr(coalesce(text, ''), 1, 12) AS title, unnest(string_split(coalesce(text, ''), chr(10))) AS text,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS entry FROM documents),
h AS (SELECT *, CASE title WHEN 'The and atti' THEN 0 WHEN 'Thntblere of' THEN 1 ELSE 2 END AS priority, regexp_replace(lower(text), '{SIGNS}', '', 'g') AS k, regexp_replace(lower(title), '{SIGNS}', '', 'g') AS t FROM l),
f AS (SELECT * FROM h WHERE contains(k, 'thewas') OR contains(t, 'thewas') OR contains(k, 'thatwas') OR contains(t, 'thatwas'))
SELECT chapter, section, title, CAST(entry AS INTEGER) AS entry, text, priority FROM f
WHERE title <> 'Thntblere of' QUALIFY row_number() OVER (PARTITION BY chapter, title, text ORDER BY priority, chapter, section, entry) = 1
""",
)
def row_search(spark, sf_dir):
    """Lines that hold a form of the query, once each, sections of two titles first, one title dropped at the end."""
    entries = corpus.flatten(sections(spark, sf_dir))
    found = corpus.search_rows(entries, "The was", [("the was", "that was")], ["The and atti", "Thntblere of"], excluded="Thntblere of")
    return found.select("chapter", "section", "title", "entry", "text", "priority")


@query(
    "search_hit_page",
    f"""
WITH l AS (SELECT source AS chapter, doc_id AS section, substr(coalesce(text, ''), 1, 12) AS title, unnest(string_split(coalesce(text, ''), chr(10))) AS text,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS entry FROM documents),
h AS (SELECT *, CASE title WHEN 'The and atti' THEN 0 ELSE 1 END AS priority, regexp_replace(lower(text), '{SIGNS}', '', 'g') AS k, regexp_replace(lower(title), '{SIGNS}', '', 'g') AS t FROM l),
f AS (SELECT * FROM h WHERE contains(k, 'the') OR contains(t, 'the') QUALIFY row_number() OVER (PARTITION BY chapter, title, text ORDER BY priority, chapter, section, entry) = 1),
n AS (SELECT chapter, section, CAST(entry AS INTEGER) AS entry, count(*) OVER () AS total, row_number() OVER (ORDER BY priority, chapter, section, entry) AS place FROM f)
SELECT chapter, section, entry, total, CAST(place AS INTEGER) AS place FROM n WHERE place <= 180
""",
)
def search_hit_page(spark, sf_dir):
    """The first 180 hits in order, with the number of all hits."""
    found = corpus.search_rows(corpus.flatten(sections(spark, sf_dir)), "the", [], ["The and atti"])
    order = [F.col(c) for c in ("priority", "chapter", "section", "entry")]
    shown = found.orderBy(*order).limit(180)
    total = found.agg(F.count("*").alias("total"))
    return shown.join(total, F.lit(True)).select("chapter", "section", "entry", "total", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query(
    "section_filter",
    f"""
WITH s AS (SELECT source AS chapter, doc_id AS section, contains(regexp_replace(lower(substr(coalesce(text, ''), 1, 12)), '{SIGNS}', '', 'g'), 'and') AS titled, string_split(coalesce(text, ''), chr(10)) AS items FROM documents),
f AS (SELECT chapter, section, CASE WHEN titled THEN items ELSE list_filter(items, lambda i: contains(regexp_replace(lower(i), '{SIGNS}', '', 'g'), 'and')) END AS items FROM s)
SELECT chapter, section, CAST(len(items) AS INTEGER) AS n_items, md5(array_to_string(items, chr(10))) AS items_md5 FROM f WHERE len(items) > 0
""",
)
def section_filter(spark, sf_dir):
    kept = corpus.filter_sections(sections(spark, sf_dir), "AND")
    return kept.select("chapter", "section", F.size("items").alias("n_items"), F.md5(F.array_join("items", "\n")).alias("items_md5"))


@query(
    "row_uniqueness",
    r"""
SELECT key, count(*) AS n FROM (SELECT '["' || replace(replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '\', '\\'), '"', '\"') || '"]' AS key FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents))
GROUP BY key HAVING count(*) > 1
""",
)
def row_uniqueness(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    return corpus.repeated_rows(lines, ["line"])


@query(
    "mirror_equality",
    SPOILT_SQL
    + """
SELECT (SELECT count(*) FROM (SELECT chapter_id, section FROM a EXCEPT ALL SELECT chapter_id, section FROM s)) AS only_a, (SELECT count(*) FROM (SELECT chapter_id, section FROM s EXCEPT ALL SELECT chapter_id, section FROM a)) AS only_b
""",
)
def mirror_equality(spark, sf_dir):
    """How a corpus and a mirror of it with planted defects differ, repeats counted."""
    found, placed = routed(spark, sf_dir)
    return corpus.same_rows(found.select("chapter_id", "section"), spoilt(placed).select("chapter_id", "section"))
