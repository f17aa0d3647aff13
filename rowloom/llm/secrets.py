"""Secret scans with corpus-wide ownership frequency.

Format rules find the base spans. Wider generators propose candidates: key blocks, signed
tokens, passwords in addresses, labelled short values and long key-like tokens. The value of
every span is hashed, and the hashes are counted over the whole corpus by distinct documents
(repositories) and distinct sources (owners): a value that several owners hold is a copied
example, a value of one owner, in however many documents, is a live-looking credential. Base
spans always stay; a candidate becomes a span only where its ownership says that it is live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import found_spans, overlapped, span_list, spread_join, staged

#: Fixed patterns of the base kinds, in their order; lookbehinds and possessive repeats only spare hopeless tries.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Candidates: a cheap test of the text, the pattern, and the part of a match that is the value.
PROPOSED = {
    "pem": ("PRIVATE KEY-----", r"-----BEGIN (?:(?!PRIVATE KEY)[A-Z ])*+PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+", r"-----([A-Za-z0-9+/=\s]+)$"),
    "jwt": ("eyJ", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", r"^(.*)$"),
    "conn": ("://", r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]++://[^\s:/@]++:[^\s:/@]{4,}+@", r":([^:]+)@$"),
    "label": (None, r"""(?<![A-Za-z0-9])(?i:pwd|pass|passphrase|auth|bearer|credential|client_secret|private_?key|access_?key)s?+["']?\x20{0,2}[:=]\x20{0,2}["']?[A-Za-z0-9+/_.=!#$%&*@^~-]{6,}+""", r"""[:=]\x20*["']?([^\s"']+)$"""),
    "token": (None, r"(?<![A-Za-z0-9+/_.@-])[A-Za-z0-9+/_-]{20,}+={0,2}", r"^(.*)$"),
}

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, *PROPOSED)


def _of_kind(spans: Column, kind: str) -> Column:
    order = KINDS.index(kind)

    def one(s: Column) -> Column:
        value = s["value"]
        if kind == "assign":
            value = F.regexp_extract(value, ASSIGN_VALUE, 1)
        elif kind in PROPOSED:
            value = F.regexp_replace(F.regexp_extract(value, PROPOSED[kind][2], 1), r"\s+", "")
        return F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), s["end"].alias("end"), value.alias("value"))

    return F.transform(spans, one)


def live_make(kind: Column, value: Column) -> Column:
    """Whether a value may be a credential by its make-up.

    A token is random throughout: letters and digits of two kinds at least, 12 different characters and for longer
    ones 0.45 of the length, up to 24; and one stretch of 12 between its marks that mixes letters and digits and is
    no hexadecimal number. So record numbers (UUIDs), commit ids and other digests, slugs
    and dates are none, nor are parts of paths and links (a plain word beside a slash), nor counted-up
    examples. What stands behind a dot or an at sign is no token either: it goes on a host or a name.
    Labelled values need a digit or sign besides letters and at least five different
    characters; the other kinds have a format of their own.
    """
    kinds = value.rlike("[0-9]").cast("int") + value.rlike("[a-z]").cast("int") + value.rlike("[A-Z]").cast("int")
    varied = F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))
    random = F.exists(F.split(value, "[-_/+=]"), lambda p: (F.length(p) >= 12) & p.rlike("[0-9]") & p.rlike("[A-Za-z]") & ~p.rlike("^[0-9A-Fa-f]+$"))
    path = value.rlike("//|(^|/)[a-z]{3,}(/|$)|^/")
    counted = value.rlike("(?i)abcdefgh|12345678|qwertyui")
    token = (kinds >= 2) & random & ~path & ~counted & (varied >= F.greatest(F.lit(12.0), F.least(F.lit(24.0), F.length(value) * 0.45)))
    labelled = value.rlike("[A-Za-z]") & value.rlike("[^A-Za-z]") & (varied >= 5)
    return F.when(kind == "token", token).when(kind == "label", labelled).otherwise(True)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", shared_owners: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``base`` and ``spans`` (arrays of start, ord, kind, end, value, owners, docs), ``n_live``, ``n_shared``.

    A null text has no spans; a null owner or doc_id counts as one of its own. Values held by
    ``shared_owners`` or more owners are shared examples; values of fewer owners are
    live-looking, however many copies of a document hold them. A candidate that overlaps a base
    span is none, nor is a token inside another candidate; other candidates may overlap.
    Repeated rows each get a result and count once in the frequencies (they agree in doc_id and
    owner). Other columns are ignored. Empty input gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    assign = F.filter(_of_kind(found_spans(body, ASSIGN), "assign"), lambda s: F.length(s["value"]) >= 8)
    columns = [assign, _of_kind(found_spans(body, ACCESS), "access"), _of_kind(found_spans(body, HEX), "hex")]
    for kind, (sign, pattern, _) in PROPOSED.items():
        found = found_spans(body, pattern)
        columns.append(_of_kind(F.when(F.contains(body, F.lit(sign)), found).otherwise(none) if sign else found, kind))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).alias("owner"), *[c.alias(k) for c, k in zip(columns, KINDS, strict=True)])
    made = F.filter(F.concat(*PROPOSED), lambda s: live_make(s["kind"], s["value"]))
    # a row number of the written table keeps repeated rows apart
    rows = staged(found.select(F.expr("uuid()").alias("row"), "doc_id", "owner", F.array_sort(F.concat(*BASE_KINDS)).alias("base"), made.alias("wide")), "secret-spans")
    spans = rows.select("row", "doc_id", "owner", F.inline(F.concat("base", "wide")))
    is_base = F.col("ord") < len(BASE_KINDS)
    spans = spans.withColumn("hit", overlapped(is_base)).filter(is_base | ~F.col("hit"))
    is_token = F.col("kind") == "token"
    spans = spans.withColumn("hit", overlapped(~is_token)).filter(~is_token | ~F.col("hit")).drop("hit").withColumn("hash", F.sha2("value", 256))
    spans = staged(spans, "secret-candidates")
    held = spans.groupBy("hash", "owner", "doc_id").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    owned = staged(held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("docs").alias("docs"), F.sum("n").alias("n")), "secret-owners")
    judged = spread_join(spans.select("row", "hash", "start", "ord", "kind", "end", "value"), owned, ["hash"], "n", F.struct("row", "start"))
    kept = judged.filter(is_base | (F.col("owners") < shared_owners))
    per_row = kept.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "ord", "kind", "end", "value", "owners", "docs"))).alias("found"),
        F.count_if(F.col("owners") >= shared_owners).alias("n_shared"),
        F.count_if(F.col("owners") < shared_owners).alias("n_live"),
    )
    out = rows.select("row", "doc_id", "base").join(per_row, "row", "left")
    return out.select(
        "doc_id",
        "base",
        F.coalesce("found", F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,value:string,owners:bigint,docs:bigint>>")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
    )


def kind_count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(scanned: DataFrame, kinds: tuple[str, ...] = BASE_KINDS) -> DataFrame:
    """Counts by base kind, the hash of the base spans, and all spans as text."""
    return scanned.select(
        "doc_id",
        *[kind_count("base", k).alias(f"n_{k}") for k in kinds],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
        *[c for c in scanned.columns if c not in ("doc_id", "base", "spans")],
    )
