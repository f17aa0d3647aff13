"""Text keys, sort keys and numbers."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rowloom.functions import numbers, sortkeys, text


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()["x"]


def test_search_key(spark):
    assert one(spark, text.search_key(F.col("v")), v="Ａb　C・d-（ー|+）1/2") == "abcdー|+12"
    assert one(spark, text.search_key(F.col("v")), v="①㌔ﾊﾞ") == "1キロバ"
    assert one(spark, text.search_key(F.lit(None).cast("string")), v=1) == ""
    assert one(spark, text.name_key(F.col("v")), v="カタ 薮髙") == "かた藪高"
    assert one(spark, text.strip_space(F.col("v"), variants=True), v="藪 髙　﨑") == "薮高崎"


def test_search_column_spans_fields(spark):
    key = text.search_column({"name": F.col("n"), "speed": F.col("s")}, {"speed": "球速"}, [F.col("g")])
    found = one(spark, key, n="A B", s=None if False else "", g="grp")
    assert "球速grp" in found and "nameab" in found


def test_query_forms():
    assert text.query_forms("球団 の球団", [("球團", "球団"), ("x", "y")]) == ["球団の球団", "球團の球団"]
    assert text.query_forms("  ", [("a", "b")]) == []


def test_names(spark):
    sim = text.name_similarity(F.col("a"), F.col("b"))
    assert one(spark, sim, a="abc", b="abc") == pytest.approx(1.0)
    assert one(spark, sim, a="abc", b="") == 0.0
    assert one(spark, sim, a="aab", b="aba") == pytest.approx(0.72 * (1 - 2 / 3) + 0.28)
    assert one(spark, F.levenshtein("a", "b"), a="神崎", b="神埼") == 1
    assert one(spark, text.batch_of(F.col("v")), v="222__222__2.png") == "222"
    assert one(spark, text.batch_of(F.col("v")), v="IMG.png") == "single"
    assert one(spark, text.printed_total(F.col("v")), v="19人 82人 201人") == 82
    assert one(spark, text.split_name(F.col("v")), v=" a  b c") == Row(family="a", given="bc")


SORTS = [("rank", True, "BCA"), ("age", True, "BAC"), ("age", False, "ABC")]


@pytest.mark.parametrize(("column", "descending", "want"), SORTS)
def test_sort(spark, column, descending, want):
    rows = spark.createDataFrame([("A", "C", "22", 1), ("B", "S", "24", 2), ("C", "A", "—", 3)], "id string, rank string, age string, i int")
    keyed = rows.withColumn("k", sortkeys.sort_key(F.col(column)))
    assert "".join(r["id"] for r in keyed.orderBy(*sortkeys.ordering("k", "i", descending)).collect()) == want


def test_sort_keys(spark):
    values = ["A+", "B", "b/SS", "148km/h", "24歳", "x10", "x2", "", None, "無", "確認", "140/150"]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = {r["i"]: r["k"] for r in rows.withColumn("k", sortkeys.sort_key(F.col("v"))).collect()}
    assert got[0].number == 12 > got[1].number and got[2].number == 15
    assert got[3].number == 148 and got[4].number == 24
    assert got[6].text < got[5].text
    assert all(got[i].blank for i in (7, 8, 9))
    status = {r["i"]: r["k"].number for r in rows.withColumn("k", sortkeys.sort_key(F.col("v"), status=True)).collect()}
    assert status[10] == 3 and status[5] == -1
    assert rows.withColumn("k", sortkeys.sort_key(F.col("v"), speed=True)).filter("i = 11").first()["k"].number == 150
    pair = rows.filter("i = 2").select(sortkeys.ability_pair(F.col("v")).alias("p")).first()["p"]
    assert (pair.limit, pair.growth) == (15, 9)


def test_numbers(spark):
    assert one(spark, numbers.round_half_up(F.col("v")), v=-0.5) == 0
    luma = numbers.ink_luma(F.col("r"), F.col("g"), F.col("b"))
    for rgb, least in (((21, 21, 53), 200), ((24, 24, 56), 210), ((38, 38, 64), 175)):
        assert one(spark, luma, r=rgb[0], g=rgb[1], b=rgb[2]) >= least
    assert one(spark, luma, r=90, g=90, b=90) == 90
    gate = numbers.ink_gate(F.col("v"), F.lit(True))
    assert [one(spark, gate, v=v) for v in (60, 59, 40, 39)] == ["name", "uncertain", "uncertain", "empty"]
    assert one(spark, numbers.bit_dice(F.col("a"), F.col("b")), a=0b1100, b=0b0110) == 0.5
    assert one(spark, numbers.likeness(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.5, 0.5]) == 0.5
    assert one(spark, numbers.dice(F.col("a"), F.col("b")), a=["x"], b=["x", "y"]) == pytest.approx(2 / 3)


def test_compatibility(spark):
    """Native normalisation against Python's: every character alone, pairs with a mark, runs of both; keys of columns and of queries agree."""
    import random
    import unicodedata

    codes = [c for c in range(1, 0x2FA20) if not 0xD800 <= c < 0xE000]
    rnd = random.Random(1)
    chars = [chr(c) for c in codes]
    compat = [c for c in chars if unicodedata.normalize("NFKC", c) != c]
    texts = chars + [a + b for a in "aeouかハホﾊﾎカ" for b in "゙゚̧́̈ﾞﾟ"]
    texts += ["".join(rnd.choice(rnd.choice((compat[:3000], ["a", "ブ", " ", "漢"]))) for _ in range(12)) for _ in range(300)]
    # marks in a row may be put in another order first, and jamo join to syllables; neither is claimed
    marked = lambda t: sum(unicodedata.combining(c) > 0 for c in unicodedata.normalize("NFKD", t)) > 1 or any(0x1100 <= ord(c) < 0x1200 for c in unicodedata.normalize("NFKD", t))
    texts = [t for t in texts if len(t) == 1 or not marked(t)]
    frame = spark.createDataFrame([(t,) for t in texts], "v string").repartition(8)
    got = {r["v"]: (r["n"], r["k"]) for r in frame.select("v", text.nfkc(F.col("v")).alias("n"), text.search_key(F.col("v")).alias("k")).collect()}
    wrong = [(t, got[t][0]) for t in texts if got[t][0] != unicodedata.normalize("NFKC", t)]
    assert not wrong, wrong[:20]
    plain = [t for t in texts if unicodedata.normalize("NFKC", t).isascii() or any("ぁ" <= c <= "鿿" for c in unicodedata.normalize("NFKC", t))]
    assert [t for t in plain if got[t][1] != text.python_key(t)] == []


def test_long_numbers_and_names(spark):
    keys = one(spark, F.array(*[sortkeys.natural_text(F.lit(v)) for v in ("p9", "p10", "p1234567890123", "p1234567890129", "p01234567890129", "q1")]), v="x")
    assert keys[:4] == sorted(set(keys[:4])) and keys[3] == keys[4] and keys[4] < keys[5]
    name = one(spark, text.split_name(F.col("v")), v=" ".join(f"t{i}" for i in range(1500)))
    assert name["family"] == "t0" and name["given"] == "".join(f"t{i}" for i in range(1, 1500))
