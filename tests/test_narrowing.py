"""Soft gates, shifted masks, edges, series and merged evidence against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rowloom.operators import gates, masks, match, series, tiers


def plain_likeness(a, b, width=32):
    bits = lambda m: {(y, x) for y, line in enumerate(m) for x in range(width) if line >> x & 1}
    one, two = bits(a), bits(b)
    if not one and not two:
        return 0.0
    score = lambda dx, dy: 2 * len(one & {(y + dy, x + dx) for y, x in two if 0 <= x + dx < width}) / (len(one) + len(two))
    best, at = 0.0, 0
    for dy in range(-3, 4):
        if score(0, dy) > best:
            best, at = score(0, dy), dy
    if best < 0.53:
        return best
    return max([best, *(score(dx, dy) for dy in range(max(-3, at - 1), min(3, at + 1) + 1) for dx in masks.COLUMNS)])


def test_shift_likeness(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(120):
        a = [rnd.getrandbits(32) & rnd.getrandbits(32) for _ in range(16)]
        if i % 4:
            dx, dy = rnd.randint(-4, 4), rnd.randint(-3, 3)
            b = [(a[y - dy] << dx if dx > 0 else a[y - dy] >> -dx) & 0xFFFFFFFF if 0 <= y - dy < 16 else 0 for y in range(16)]
            b = [x & ~(rnd.getrandbits(32) & rnd.getrandbits(32) & rnd.getrandbits(32)) for x in b]
        else:
            b = [0] * 16 if i % 8 else [rnd.getrandbits(32) for _ in range(16)]
        rows.append((i, a, b))
    rows += [(998, [0] * 16, [0] * 16)]
    table = spark.createDataFrame([*rows, (999, None, rows[0][1])], "i int, a array<long>, b array<long>")
    got = {r["i"]: r["s"] for r in table.select("i", masks.shift_likeness(F.col("a"), F.col("b"), 32).alias("s")).collect()}
    for i, a, b in rows:
        assert got[i] == pytest.approx(plain_likeness(a, b)), i
    assert got[999] == 0.0
    kept = table.select("i", masks.unless_blank(F.col("a"), 32, 16).alias("m")).filter("m is null").collect()
    assert {998, 999} <= {r["i"] for r in kept}


EDGES = [  # k, mean, least, widest, shape_mean, shape_least -> k and rule
    ([(1, 0.93, 0.93, 0.93, 0.1, 0.1)], (1, "pixel")),
    ([(1, 0.90, 0.90, 0.90, 0.1, 0.1)], None),  # accepted, but not decisive, and no shapes
    ([(4, 0.78, 0.73, 0.9, 0.1, 0.1)], (4, "pixel")),
    ([(2, 0.79, 0.74, 0.9, 0.1, 0.1)], None),
    ([(4, 0.80, 0.75, 0.9, 0.1, 0.1), (3, 0.78, 0.7, 0.9, 0.1, 0.1)], None),  # a rival stands near
    ([(4, 0.95, 0.75, 0.99, 0.1, 0.1), (3, 0.93, 0.7, 0.99, 0.1, 0.1)], (4, "pixel")),
    ([(4, 0.60, 0.5, 0.7, 0.85, 0.80)], (4, "alone")),
    ([(4, 0.60, 0.5, 0.7, 0.75, 0.65)], None),
    ([(4, 0.69, 0.5, 0.8, 0.75, 0.65)], (4, "several")),
    ([(4, 0.69, 0.5, 0.8, 0.75, 0.65), (3, 0.3, 0.2, 0.4, 0.72, 0.66)], None),  # shapes aren't clear
    ([(1, 0.80, 0.80, 0.80, 0.78, 0.78), (2, 0.5, 0.4, 0.70, 0.2, 0.1)], (1, "single")),
    ([(1, 0.80, 0.80, 0.80, 0.78, 0.78), (2, 0.5, 0.4, 0.76, 0.2, 0.1)], None),  # a neighbour is as alike
    ([(4, 0.80, 0.75, 0.9, 0.95, 0.9), (3, 0.78, 0.7, 0.9, 0.2, 0.1)], None),  # the pixels' rival bars shapes too
]


def test_edges(spark):
    rows = [(1, page, *o) for page, (options, _) in enumerate(EDGES) for o in options]
    options = spark.createDataFrame(rows, "batch int, page int, k int, mean double, least double, widest double, shape_mean double, shape_least double")
    got = {r["page"]: (r["k"], r["rule"]) for r in masks.decide_edges(options).collect()}
    assert got == {page: want for page, (_, want) in enumerate(EDGES) if want}


def plain_gates(q, roster):
    pool, flags = roster, []

    def take(wanted, test, most=None):
        nonlocal pool
        left = [r for r in pool if test(r)]
        taken = wanted and bool(left) and (most is None or len(left) <= most)
        flags.append(taken)
        pool = left if taken else pool

    take(bool(q["position"]), lambda r: r["position"] == q["position"])
    take(bool(q["hand"]), lambda r: r["hand"] == q["hand"])
    alike = lambda r: round(likeness(q["family"] or "", r["family"]), 9)
    best = max((alike(r) for r in pool), default=0)
    take(bool(q["family"]) and best >= 0.48, lambda r: alike(r) >= max(0.42, round(best - 0.08, 9)), 220)
    for part in ("family", "given"):
        n = q[f"{part}_length"]
        take(n is not None, lambda r, n=n, part=part: n is not None and abs(len(r[part]) - n) <= 1)
    return flags, {r["uid"] for r in pool}


def likeness(a, b):
    if not a or not b:
        return 0.0
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, old = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (x != y)))
    common = sum(min(a.count(c), b.count(c)) for c in set(a))
    return max(0.0, (1 - d[-1] / max(len(a), len(b))) * 0.72 + 2 * common / (len(a) + len(b)) * 0.28)


def test_gates(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 5)))
    roster = [{"uid": i, "position": rnd.choice(["p", "c", ""]), "hand": rnd.choice(["r", "l"]), "family": rnd.choice(["aaaa", "abcd", word()]), "given": word(), "age": 20} for i in range(600)]
    queries = [{"query_id": i, "position": rnd.choice(["p", "z", "", None]), "hand": rnd.choice(["r", "x", ""]), "family": rnd.choice([word(), "aaaa", "zzz", "", None]), "family_length": rnd.choice([None, 2, 4, 40]), "given_length": rnd.choice([None, 3, 40])} for i in range(60)]
    q = spark.createDataFrame([tuple(x.values()) for x in queries], "query_id int, position string, hand string, family string, family_length int, given_length int")
    table = spark.createDataFrame([tuple(x.values()) for x in roster], "uid int, position string, hand string, family string, given string, age int")
    found = gates.pool_members(gates.narrowed_cells(q, table), table).collect()
    got, pools = {}, {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["uid"])
        pools[r["query_id"]] = ([r["by_position"], r["by_hand"], r["by_family"], r["by_family_length"], r["by_given_length"]], r["pool"])
    for x in queries:
        flags, members = plain_gates(x, roster)
        assert got[x["query_id"]] == members, x
        assert pools[x["query_id"]] == (flags, len(members))
    assert sum(1 for r in found if r["query_id"] == 0) == len(got[0])  # no record twice
    for i in range(5):
        assert len({f[0][i] for f in pools.values()}) == 2  # every gate is taken and refused


def test_gates_ask_once(spark):
    """Queries that ask alike take the same gates, and pairs of a query and a cell of the roster are never made."""
    roster = [(i, "pc"[i % 2], "rl"[i % 3 % 2], "abcdefgh"[i % 8] * (i % 5 + 1), "x" * (i % 7), 20) for i in range(300)]
    table = spark.createDataFrame(roster, "uid int, position string, hand string, family string, given string, age int")
    kinds = [("p", "r", "aaa", 3, 2), ("", "", "bbbb", None, 40), (None, "l", None, 2, None)]
    q = spark.createDataFrame([(i, *kinds[i % 3]) for i in range(90)], "query_id int, position string, hand string, family string, family_length int, given_length int")
    names = ("uid", "position", "hand", "family", "given", "age")
    plain = [plain_gates(dict(zip(("position", "hand", "family", "family_length", "given_length"), k)), [dict(zip(names, r)) for r in roster]) for k in kinds]
    got = gates.narrowed(q, table).collect()
    assert len(got) == 90
    for r in got:
        flags, members = plain[r["query_id"] % 3]
        assert ([r[f] for f in gates.FLAGS], r["pool"]) == (flags, len(members))


def test_refine(spark):
    rows = [(1, 10, 1, 0.5, 0.5), (1, 11, 2, 0.49, 0.6), (1, 12, 15, 0.3, 0.9), (2, 10, 1, 0.8, 0.1), (2, 11, 2, 0.6, 0.9), (3, 10, 1, 0.3, 0.1), (3, 11, 2, 0.29, 0.9)]
    table = spark.createDataFrame(rows, "query_id int, uid int, place int, coarse double, fine double")
    got = {r["query_id"]: (r["uid"], r["score"], r["refined"], r["refined_uid"]) for r in match.refine(table).collect()}
    assert got == {1: (11, 0.5318, True, 12), 2: (10, 0.8, False, 11), 3: (10, 0.3, False, 11)}


def test_series(spark):
    rnd = random.Random(2)
    values = {g: [rnd.randint(0, 9) + 30 * (i % 30 < 3) for i in range(150)] for g in "ab"}
    rows = [(g, i, v) for g, vs in values.items() for i, v in enumerate(vs) if v]
    rows = series.dense(spark.createDataFrame([*rows, ("a", 149, 1), ("c", 5, 7)] if not values["a"][149] else [*rows, ("c", 5, 7)], "g string, q int, v int"), ["g"], "q", "v")
    smooth = series.smoothed(rows, ["g"], "q", "v")
    weights = {k: math.exp(-0.5 * (k / 8) ** 2) for k in range(-24, 25)}
    for r in smooth.filter("g = 'b'").collect():
        want = sum(values["b"][r["q"] + k] * w for k, w in weights.items() if 0 <= r["q"] + k < 150) / sum(weights.values())
        assert abs(r["smooth"] - want) < 1e-9
    found = {r["g"]: r["lag"] for r in series.best_lag(smooth.withColumn("z", F.col("v") - F.col("smooth")), ["g"], "q", "z").collect()}
    assert found == {"a": 30, "b": 30, "c": 36}
    runs = series.widest_run(rows, ["g"], "q", F.col("v") > 4, F.lit(10), F.lit(120), least=3)
    for r in runs.collect():
        if r["g"] == "c":
            assert r["start"] is None
            continue
        best, at = None, 10
        while at < 120:
            end = at
            while end < 120 and values[r["g"]][end] > 4:
                end += 1
            if end - at >= 3 and (best is None or end - at > best[1] - best[0]):
                best = (at, end)
            at = end + 1
        assert (r["start"], r["stop"]) == best


def test_evidence_ignores_order(spark):
    rows = [(1, n, f, g, p, h, a, c) for n, f, g, p, h, a, c in [(3, "ab", "x", "", "r", None, 5), (1, "ab", "", "p", "", 20, 9), (2, "", "y", "q", None, 30, None)]] + [(2, 7, None, "", None, "", None, None)]
    schema = "k int, o int, family string, given string, position string, hand string, age int, confidence int"
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = {r["key"]: r.asDict() for r in tiers.as_evidence(spark.createDataFrame(rows, schema).repartition(3), "k", "o").collect()}
        assert want is None or got == want
        want = got
    assert want[1]["names"] == ["ab", "y", "abx"] and want[1]["families"] == ["ab"] and want[1]["givens"] == ["y", "x"]
    assert (want[1]["position"], want[1]["hand"], want[1]["age"], want[1]["confidence"], want[1]["first_index"], want[1]["n"]) == ("p", "r", 20, 9, 1, 3)
    assert want[2]["names"] == [] and want[2]["position"] == ""
