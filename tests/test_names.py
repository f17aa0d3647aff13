"""Similar names against all pairs of keys, without blocking by ends or lengths."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rowloom.functions import numbers, text
from rowloom.operators import match

NAMES = ["abcdefghij", "jihgfedcba", "aabbccddeeffgghhiijj", "xbcdefghiy", "abcdefgh", "ghijabcdef", "small red box", "tall red box", "a", "aaaaaaa", "annaberg", "xnnabexy", "bannaberx", "ab", "ba", "abc", "abd", "aab", "", None]


def many(n):
    """Names of three to seven syllables, some of them with a letter changed."""
    rnd = random.Random(4)
    syllables = [a + b for a in "kstnhm" for b in "aiueo"]
    names = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 7))) for _ in range(n)]
    return names + [x[:2] + "q" + x[3:] for x in names[::7]]


@pytest.mark.parametrize("least", [0.7, 0.8])
@pytest.mark.parametrize("names", [NAMES, many(400)], ids=["few", "many"])
def test_all_pairs(spark, least, names):
    letters = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))
    dice = lambda a, b: numbers.dice(letters(a), letters(b))
    score, search = (dice, match.dice_names) if least == 0.8 else (text.name_similarity, match.alike_names)
    given = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = spark.createDataFrame([tuple(sorted(p)) for p in combinations({n for n in names if n}, 2)], "a string, b string")
    want = {(r["a"], r["b"]) for r in pairs.filter(score(F.col("a"), F.col("b")) >= least).collect()}
    got = [(r["name_a"], r["name_b"]) for r in search(given, F.col("name"), least).collect()]
    assert sorted(got) == sorted(want) and want


def test_few_candidates(spark):
    """What passes the join is a small part of all pairs."""
    given = spark.createDataFrame([(n,) for n in many(3000)], "name_key string").distinct()
    bags = match._in_order(given.withColumn("bag", F.array_sort(match.letter_bag(F.col("name_key")))))
    n = bags.count()
    bound = lambda c, a, b: c / F.greatest(a, b) * 0.72 + 2 * c / (a + b) * 0.28 >= 0.7 - 1e-9
    assert match.sharing_bags(bags.select("bag").distinct(), 0.66, bound).count() < n * (n - 1) / 20


def test_every_name_is_asked(spark):
    """All names are read, not those of some ids alone."""
    from rowloom.plans import agreement

    names = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name").distinct().count()
    assert agreement.text_match(spark, "/root/testdata/sf0.001").select("truth").distinct().count() == names
