"""Personal data by candidate gradient boosting.

Format rules find the base spans, which always stay. Generators of high recall propose
candidates, overlapping ones too: disguised and spaced forms, other formats, and the base
formats themselves. A candidate's label comes from evidence on its normalised value (checksums,
ranges, parts that have to be there), which no feature holds; boosted trees (MLlib) learn from
format and context how likely such evidence is. Held-out candidates calibrate that by kind.
A candidate with the evidence becomes a span where its place makes it likely enough to be more
than a number that passes by chance.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import found_spans, overlapped, staged

KINDS = ("email", "ip", "card", "phone")

#: Fixed patterns of the base kinds. A try that starts inside a run that has failed as a whole fails too;
#: lookbehinds spare it, and \G keeps starts right after a match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?(?:@|[(\[{<]\x20?(?i:at|@)\x20?[)\]}>])\x20?)"
_DOT = r"(?:\.|\x20\.\x20|\x20?[(\[{<]\x20?(?i:dot|\.)\x20?[)\]}>]\x20?|\x20(?i:dot)\x20)"
#: Generators: disguised, spaced and plain forms of the base kinds, and other formats of such data.
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++|\x20(?i:at)\x20[A-Za-z0-9-]++(?:\x20(?i:dot)\x20[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|\x20\.\x20|\x20?[(\[{]\x20?(?:\.|(?i:dot))\x20?[)\]}]\x20?)[0-9]{1,3}+){3}(?![0-9.]*[0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}+[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)?\(?[0-9]{1,4}+\)?(?:[\x20./-]{1,2}+\(?[0-9]{2,5}+\)?){2,5}+(?![0-9])",
    "ip6": r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+(?![0-9A-Za-z:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{1,4}+){3,8}+(?![A-Za-z0-9])",
}
ALL_KINDS = tuple(WIDE)
#: Words before a span that speak for its kind.
CONTEXT = {"email": "mail|contact|write", "ip": "ip|host|addr|server", "card": "card|visa|credit|pay", "phone": "tel|phone|call|mobil|fax", "ip6": "ip|host|addr|server", "iban": "iban|bank|account|konto"}
#: Last parts of addresses that may be spelled out by bare words ("at", "dot"), where any word could stand; English words among country codes are left out (fixed values).
SPELLED = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|ai|co|uk|de|fr|es|nl|ch|ru|cn|jp|kr|br|ca|au|eu|pl|se|fi|dk|cz|pt|gr|ie|nz|za|mx|test|example"
#: How often a number without meaning passes a kind's checksum.
BY_CHANCE = {"card": 0.1, "iban": 1 / 97}

FEATURES = (*[f"kind_{k}" for k in ALL_KINDS], "length", "digits", "letters", "marks", "groups", "longest", "shortest", "varied", "at_sign", "brackets", "spaced", "leading_plus", "context", "labelled", "before_word", "after_word", "line_start")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    reversed_digits = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(reversed_digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The contract's check of a base match."""
    n = F.length(_digits(value))
    if kind == "ip":
        # nine digits fit an int; zeros in front don't count
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(9)).cast("int") <= 255))
    if kind == "card":
        return (n >= 12) & (n <= 19) & luhn(value)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def normalised(kind: str, value: Column) -> Column:
    """A candidate without its disguise."""
    if kind == "email":
        bare = F.regexp_replace(value, r"(?i)\x20?[(\[{<]\x20?(?:at|@)\x20?[)\]}>]\x20?|\x20at\x20|\x20?@\x20?", "@")
        return F.regexp_replace(bare, r"(?i)\x20?[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>]\x20?|\x20dot\x20|\x20\.\x20", ".")
    if kind == "ip":
        return F.regexp_replace(value, "[^0-9]+", ".")
    if kind in ("card", "phone"):
        return _digits(value)
    return F.regexp_replace(value, r"[\x20-]", "")


def disguised(kind: Column, value: Column) -> Column:
    """A candidate in a form that the base rules don't know, with the same evidence."""
    email = F.replace(F.replace(value, F.lit("@"), F.lit(" (at) ")), F.lit("."), F.lit(" (dot) "))
    grouped = F.regexp_replace(F.regexp_replace(value, r"[^0-9A-Z]", ""), "(.{4})(?=.)", "$1.")
    plain = F.regexp_replace(F.regexp_replace(value, r"[()]", ""), r"[\x20./]+", "-")
    return F.when(kind == "email", email).when(kind == "ip", F.regexp_replace(value, "[^0-9]+", "[.]")).when(kind == "card", grouped).when(kind == "phone", plain).otherwise(value)


def mod97(value: Column) -> Column:
    """Whether an account number leaves 1 when divided by 97: the first four signs moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(value, 5, 40), F.left(value, F.lit(4)))
    signs = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(signs, F.lit(0), lambda a, d: F.when(d > 9, a * 100 + d).otherwise(a * 10 + d) % 97) == 1


def evident(kind: str, value: Column) -> Column:
    """The evidence that labels a candidate, on its normalised value."""
    plain = normalised(kind, value)
    n = F.length(_digits(value))
    if kind == "email":
        whole = plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,10}$")
        # bare words read like prose: "me at noon dot on"
        return whole & (~value.rlike(r"(?i)\x20(at|dot)\x20") | plain.rlike(rf"(?i)\.({SPELLED})$"))
    if kind == "ip":
        return valid("ip", plain)
    if kind == "card":
        return valid("card", plain) & ~plain.rlike(r"^(.)\1*$")
    if kind == "phone":
        # without a country's sign: a trunk zero, a leading 1 before ten digits, or an area code and 3 and 4 digits; pairs of other numbers, dates and part numbers aren't
        national = value.rlike(r"^\(?0[0-9]") | value.rlike(r"^\(?1[\x20./-]*\(?[2-9][0-9]{2}\)?[\x20./-]+[0-9]{3}[\x20./-]+[0-9]{4}$") | value.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20./-]+[0-9]{3}[\x20./-]+[0-9]{4}$")
        date = value.rlike(r"^0?[0-9]{1,2}[./-][0-9]{1,2}[./-](19|20)[0-9]{2}\b|^(19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}\b")
        return (n >= 9) & (n <= 15) & ~date & (value.rlike(r"^(\+|00)") | ((n >= 10) & (n <= 11) & national))
    if kind == "ip6":
        groups, gaps = F.size(F.filter(F.split(value, ":"), lambda g: g != "")), F.size(F.split(value, "::")) - 1
        # names of code stand around double colons too: a short form needs digits, and three groups or a known beginning
        short = value.rlike("[0-9]") & ((groups >= 3) | value.rlike("(?i)^(fe80|f[cd][0-9a-f]{2}|2[0-9a-f]{3})::"))
        return ((gaps == 0) & (groups == 8)) | ((gaps == 1) & short & (groups <= 7) & ~value.rlike(":::"))
    return (F.length(plain) >= 15) & (F.length(plain) <= 34) & mod97(plain)


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(ALL_KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A written table of row, doc_id, ``base`` spans and ``wide`` candidates with 24 characters before them and 2 after."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    # what no match can do without, tested first: scanning costs far more
    needs = {"email": F.contains(body, F.lit("@")) | (body.rlike(r"(?i)\bat\b") & body.rlike(r"(?i)\bdot\b")), "ip6": body.rlike("[0-9A-Fa-f]:[0-9A-Fa-f:]"), "iban": body.rlike("[A-Z]{2}[0-9]{2}")}
    digit = body.rlike("[0-9]")
    at_sign = F.contains(body, F.lit("@"))

    def base_spans(kind: str) -> Column:
        found = F.when(at_sign if kind == "email" else digit, found_spans(body, BASE[kind])).otherwise(none)
        return F.filter(_tagged(found, kind), lambda s: valid(kind, s["value"])).alias(f"base_{kind}")

    wide = [_tagged(F.when(needs.get(k, digit), found_spans(body, WIDE[k])).otherwise(none), k).alias(f"wide_{k}") for k in ALL_KINDS]
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), *map(base_spans, KINDS), *wide)
    shown = F.transform(
        F.concat(*[f"wide_{k}" for k in ALL_KINDS]),
        lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), F.substring(F.col("body"), F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))).alias("left"), F.substring(F.col("body"), s["end"] + 1, F.lit(2)).alias("right")),
    )
    rows = rows.select(F.expr("uuid()").alias("row"), "doc_id", F.array_sort(F.concat(*[f"base_{k}" for k in KINDS])).alias("base"), shown.alias("wide"))
    return staged(rows, "pii-candidates")


def with_features(spans: DataFrame) -> DataFrame:
    """Format and context of each span; nothing of the evidence but its shape."""
    value, left = F.col("value"), F.lower("left")
    digits = _digits(value)
    parts = F.transform(F.filter(F.split(value, "[^A-Za-z0-9]+"), lambda p: p != ""), lambda p: F.length(p))
    context = F.lit(False)
    for k, words in CONTEXT.items():
        context |= (F.col("kind") == k) & left.rlike(words)
    return spans.withColumns(
        {f"kind_{k}": (F.col("kind") == k).cast("double") for k in ALL_KINDS}
        | {
            "length": F.length(value).cast("double"),
            "digits": F.length(digits).cast("double"),
            "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")).cast("double"),
            "marks": F.length(F.regexp_replace(value, "[A-Za-z0-9\\x20]", "")).cast("double"),
            "groups": F.size(parts).cast("double"),
            "longest": F.coalesce(F.array_max(parts), F.lit(0)).cast("double"),
            "shortest": F.coalesce(F.array_min(parts), F.lit(0)).cast("double"),
            "varied": F.size(F.array_distinct(F.split(digits, ""))).cast("double"),
            "at_sign": F.contains(value, F.lit("@")).cast("double"),
            "brackets": value.rlike(r"[(\[{<]").cast("double"),
            "spaced": F.contains(value, F.lit(" ")).cast("double"),
            "leading_plus": value.rlike(r"^(\+|00)").cast("double"),
            "context": context.cast("double"),
            "labelled": left.rlike("[:=#]\\s*$").cast("double"),
            "before_word": left.rlike("[\\p{L}0-9_]$").cast("double"),
            "after_word": F.col("right").rlike("^[\\p{L}0-9_]").cast("double"),
            "line_start": left.rlike("(^|\\n)\\s*$").cast("double"),
        }
    )


def fit(spans: DataFrame, max_train: int, rounds: int, depth: int):
    """Boosted trees and the calibration, or None where the sample has one label only.

    The sample is the ``max_train`` candidates with the smallest hash of their content, and each
    of them once more in disguise, since a corpus may hold few of that kind; a fifth of it, by
    hash, is held out. The calibration gives, by kind and by tenths of the trees'
    probability, the share of held-out candidates with evidence, drawn towards that probability by
    two more candidates.
    """
    content = ("value", "left", "right", "kind")
    sample = spans.select(*content, F.col("label").cast("double").alias("label"), F.xxhash64(*content).alias("mixed")).orderBy("mixed", *content).limit(max_train)
    sample = sample.union(sample.withColumn("value", disguised(F.col("kind"), F.col("value"))))
    sample = staged(with_features(sample).select("label", "mixed", "kind", *FEATURES), "pii-sample")
    counts = {r["label"]: r["count"] for r in sample.filter("pmod(mixed, 5) <> 0").groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    inputs = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = inputs.transform(sample.filter("pmod(mixed, 5) <> 0")).coalesce(4)
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, maxBins=32, seed=7, cacheNodeIds=False).fit(train)
    held = model.transform(inputs.transform(sample.filter("pmod(mixed, 5) = 0"))).select("kind", "label", F.round(vector_to_array("probability")[1], 1).alias("bin"))
    bins = held.groupBy("kind", "bin").agg(F.sum("label").alias("hit"), F.count("*").alias("n")).collect()  # 66 rows at most
    return inputs, model, [(r["kind"], r["bin"], (r["hit"] + 2 * r["bin"]) / (r["n"] + 2)) for r in bins]


def likely(scored: DataFrame, calibration: list[tuple[str, float, float]]) -> DataFrame:
    """Add ``sure``: how likely a candidate with evidence is real.

    ``v`` is the calibrated share of candidates of its kind and place that have evidence. Where
    a checksum passes by chance in a share ``a`` of numbers, ``v`` is made of real ones r and
    chance a (1 - r), so that r / v of those that pass are real.
    """
    p = vector_to_array("probability")[1]
    share = F.lit(None).cast("double")
    for kind, bin_, v in calibration:
        share = F.when((F.col("kind") == kind) & (F.round(p, 1) == bin_), v).otherwise(share)
    chance = F.lit(0.0)
    for kind, a in BY_CHANCE.items():
        chance = F.when(F.col("kind") == kind, a).otherwise(chance)
    v = F.coalesce(share, p)
    by_sum = F.greatest(F.lit(0.0), (v - chance) / (v * (1 - chance)))
    return scored.withColumn("sure", F.when(chance > 0, by_sum).otherwise(v))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_train: int = 20_000, rounds: int = 8, depth: int = 4, least: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``base`` and ``spans`` (arrays of start, ord, kind, end, value) and ``n_added``.

    A candidate with evidence that is ``least`` likely to be real and overlaps no base span is
    added; added ones of different kinds may overlap each other. A null text has no spans;
    repeated rows each get a result; other columns are ignored; empty input gives no rows. Where
    the corpus has no candidates of both labels there is nothing to learn, and evidence alone
    decides. ``max_train`` bounds the sample that trees are fitted on.
    """
    rows = candidates(docs, doc_id, text)
    label = F.lit(False)
    for kind in ALL_KINDS:
        label = F.when(F.col("kind") == kind, evident(kind, F.col("value"))).otherwise(label)
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,value:string>>")
    wide = rows.select("row", F.inline("wide")).withColumn("label", label)
    fitted = fit(wide, max_train, rounds, depth)
    marked = wide.withColumn("base", F.lit(False)).unionByName(rows.select("row", F.inline("base")).withColumn("base", F.lit(True)), allowMissingColumns=True)
    free = marked.withColumn("hit", overlapped(F.col("base"))).filter("not base and not hit and label")
    if fitted is not None:
        inputs, model, calibration = fitted
        free = likely(model.transform(inputs.transform(with_features(free))), calibration).filter(F.col("sure") >= least)
    added = free.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "kind", "end", "value"))).alias("added"))
    out = rows.select("row", "doc_id", "base").join(added, "row", "left").withColumn("added", F.coalesce("added", empty))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
