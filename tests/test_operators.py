"""Paging, comparison, routing, stitching, matching rules, tiers and gates."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rowloom.functions import text
from rowloom.operators import corpus, kernels, match, roster, stitch, tiers
from rowloom.sources import ingest


def test_pages(spark):
    rows = spark.createDataFrame([("a", i) for i in range(95)] + [("b", i) for i in range(3)], "g string, i int")
    numbered = roster.page_of(rows, [F.col("g")], [F.col("i")])
    assert {(r["g"], r["page"], r["pages"]) for r in numbered.collect()} == {("a", 1, 3), ("a", 2, 3), ("a", 3, 3), ("b", 1, 1)}
    last = roster.fetch_page(rows, ["g"], [F.col("i")], page=9)
    assert sorted((r["g"], r["i"]) for r in last.collect()) == [("a", i) for i in range(80, 95)] + [("b", i) for i in range(3)]


def test_compare_set():
    chosen = []
    for i in range(21):
        chosen = roster.toggle(chosen, i)
    assert chosen == list(range(20)) and roster.toggle(roster.toggle(chosen, 3), 20)[-1] == 20
    assert roster.toggle([1], 9, known={1, 2}) == [1]


def test_compare(spark):
    rows = spark.createDataFrame([(1, "x", "–", None), (2, "", "–", "7")], "id int, a string, b string, c string")
    got = roster.compare(rows, spark.createDataFrame([(2, 1), (1, 2), (9, 3)], "id int, slot int"), "id", slots=3).collect()
    assert {r["attribute"]: (r["s1"], r["s2"], r["s3"]) for r in got} == {"a": ("—", "x", "—"), "c": ("7", "—", "—")}


def test_name_fix_is_scoped(spark):
    rows = spark.createDataFrame([("n", "外野手"), ("n", "投手")], "name string, position string")
    fixes = spark.createDataFrame([("n", "外野手", "m")], "name string, position string, new_name string")
    got = {r["position"]: (r["name"], r["_name_orig"]) for r in roster.correct_names(rows, fixes, "name", ["position"]).collect()}
    assert got == {"外野手": ("m", "n"), "投手": ("n", None)}


def test_routing(spark):
    sections = spark.createDataFrame([("c1", 0), ("c1", 1), ("c2", 0)], "chapter_id string, section int")
    frames = [spark.createDataFrame(r, s) for r, s in (([("c1", "t")], "chapter_id string, place string"), ([("c1", 1, "o")], "chapter_id string, section int, place string"), ([("c2",)], "chapter_id string"))]
    placed = corpus.require_routing(sections, corpus.route(sections, *frames))
    assert sorted((r["reading_id"], r["place"]) for r in placed.collect()) == [("c1:0", "t"), ("c1:1", "o"), ("c2:0", "archive")]
    with pytest.raises(corpus.RoutingError):
        corpus.require_routing(sections, corpus.route(sections, frames[0], frames[1], frames[2].limit(0)))
    with pytest.raises(corpus.RoutingError):
        corpus.require_routing(sections, corpus.route(sections, frames[0].union(frames[0]), *frames[1:]))


def test_rows_win_over_items(spark):
    s = spark.createDataFrame([("c", 1, "t", [["a", None]], ["i"]), ("c", 2, "t", [], ["j"]), ("c", 3, "t", None, None)], "chapter string, section int, title string, rows array<array<string>>, items array<string>")
    assert [(r["kind"], r["text"]) for r in corpus.flatten(s).orderBy("section").collect()] == [("row", "a｜"), ("item", "j")]
    assert [r["x"] for r in s.select(corpus.entry_count(F.col("rows"), F.col("items")).alias("x")).collect()] == [2, 1, 0]


def slow_groups(pages, overlaps):
    ids = [(p, r) for p, n in enumerate(pages) for r in range(1, n + 1)]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, k in overlaps.items():
        for j in range(k):
            root[find((p, pages[p] - k + j + 1))] = find((p + 1, j + 1))
    groups = {}
    for i in ids:
        groups.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, groups.values()))


def test_positions_equal_union_find(spark):
    rnd = random.Random(4)
    rows, overlaps, want = [], [], {}
    for b in range(40):
        pages = [rnd.randint(1, 6) for _ in range(rnd.randint(1, 7))]
        ks = {p: rnd.randint(0, min(pages[p], pages[p + 1])) for p in range(len(pages) - 1)}
        want[str(b)] = slow_groups(pages, ks)
        rows += [(str(b), p, r, 0) for p, n in enumerate(pages) for r in range(1, n + 1)]
        overlaps += [(str(b), p, k) for p, k in ks.items()]
    placed = stitch.positions(spark.createDataFrame(rows, "batch string, page int, row int, payload int"), spark.createDataFrame(overlaps, "batch string, page int, k int"))
    got = {}
    for r in placed.collect():
        got.setdefault(r["batch"], {}).setdefault(r["position"], []).append((r["page"], r["row"]))
    assert {b: sorted(map(sorted, g.values())) for b, g in got.items()} == want


TENTATIVE = [
    # score, second, visual, same name, category, position, expected
    (0.60, 0.50, 0.55, 1, "", "投手", True),
    (0.60, 0.53, 0.55, 1, "", "投手", False),
    (0.56, 0.51, 0.51, 1, "投手", "投手", True),
    (0.56, 0.51, 0.51, 1, "捕手", "投手", False),
    (0.66, 0.62, 0.60, 1, "", "投手", True),
    (0.90, 0.50, 0.90, 2, "", "投手", False),
    (0.90, None, 0.90, 1, "", "投手", False),
    (0.56, 0.51, 0.51, 1, "內野手", "游擊手", True),
]


def test_tentative(spark):
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(TENTATIVE)], "i int, s double, z double, v double, n int, c string, p string, want boolean")
    got = match.tentative(F.col("s"), F.col("z"), F.col("v"), F.col("n"), F.col("c"), match.fits_category(F.col("c"), F.col("p")))
    assert all(r["want"] == r["got"] for r in rows.withColumn("got", got).collect())


def test_reconcile_and_corroborate(spark):
    S = lambda u, s, m, x: Row(uid=u, score=s, margin=m, matched=x)  # noqa: E731, N806
    cases = [
        (S(1, 0.7, 0.12, False), S(1, 0.7, 0.12, False), "promoted"),
        (S(1, 0.7, 0.12, False), S(2, 0.9, 0.3, True), "primary"),
        (S(1, 0.7, 0.05, False), S(1, 0.67, 0.2, True), "alternate"),
        (S(1, 0.7, 0.05, False), S(1, 0.60, 0.2, True), "primary"),
        (S(1, 0.66, 0.12, False), S(1, 0.7, 0.12, False), "primary"),
    ]
    kind = "struct<uid:int,score:double,margin:double,matched:boolean>"
    rows = spark.createDataFrame([(p, a, w) for p, a, w in cases], f"p {kind}, a {kind}, want string")
    assert all(r["want"] == r["got"] for r in rows.withColumn("got", match.reconcile(F.col("p"), F.col("a"), F.lit(1))).collect())
    both = spark.createDataFrame([(S(1, 0.8, 0.2, True), S(1, 0.75, 0.2, True))], f"a {kind}, b {kind}")
    base = F.struct(F.lit(0.5).alias("score"), F.lit(False).alias("matched"))

    def outcome(n, independent):
        return both.select(match.corroborate(base, F.col("a"), F.col("b"), F.lit(n), F.lit(independent)).alias("x")).first()["x"]

    assert [outcome(1, True), outcome(1, False), outcome(2, True)] == ["confirmed", "candidate", "unchanged"]


def test_consensus(spark):
    def attempts(row, tops):
        return [(row, i, p, u, s, False) for i, pair in enumerate(tops) for p, (u, s) in enumerate(pair, 1)]

    data = attempts("win", [[(1, 0.78), (2, 0.5)]] * 4) + attempts("tie", [[(1, 0.78), (2, 0.5)]] * 2 + [[(2, 0.78), (1, 0.5)]] * 2) + attempts("weak", [[(1, 0.6), (2, 0.3)]] * 4)
    rows = spark.createDataFrame(data, "row string, attempt int, place int, uid int, score double, matched boolean")
    names = spark.createDataFrame([(1, 1), (2, 1)], "uid int, same_name int")
    assert {r["row"]: r["accepted"] for r in match.consensus(rows, names).collect()} == {"win": True, "tie": False, "weak": False}


def test_tier_order(spark):
    data = [("b", i, 0.9 - i / 100, 5 if i < 2 else None, 6 if i == 2 else None, "x") for i in range(4)]
    rows = spark.createDataFrame(data, "batch string, first_index int, score double, match int, resolved int, status string")
    done = tiers.finish(rows, "batch", F.lit("same"), F.lit(None).cast("int"), ["batch"])
    assert {r["first_index"]: (r["match"], r["resolved"]) for r in done.collect()} == {0: (None, None), 1: (None, None), 2: (None, 6), 3: (None, None)}


def test_tables():
    html = "<table><tr><th>名前</th></tr><tr><td>q</td></tr></table><table><tr><th>名前</th><th>年齢</th></tr><tr><td>a&amp;b  c</td></tr><tr><td></td><td>3</td></tr></table>"
    assert ingest.widest_table(html, "名前") == [{"名前": "a&b c", "年齢": ""}]
    assert ingest.widest_table(None, "名前") == []


def test_gates(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s2")], "name string, slug string")
    gate = lambda n: lambda df: ingest.require(df, "name", "slug", n, {"s1": 2, "s2": 1})
    path = str(tmp_path / "roster")
    assert ingest.publish(rows, path, gate(3)).count() == 3
    with pytest.raises(ingest.GateError):
        ingest.publish(rows.limit(2), path, gate(3))
    assert ingest.read_published(spark, path).count() == 3
    more = rows.withColumn("name", F.upper("name"))
    ingest.publish(more, path, gate(3), meta=spark.createDataFrame([(3,)], "n int"))
    assert {r["name"] for r in ingest.read_published(spark, path).collect()} == {"A", "B", "C"}
    assert ingest.read_published(spark, path, "meta").first()["n"] == 3
    few, right = str(tmp_path / "few"), str(tmp_path / "right")
    rows.limit(2).write.parquet(few)
    rows.write.parquet(right)
    found = ingest.first_valid(spark, [("gone", str(tmp_path / "none")), ("wrong", few), ("right", right)], gate(3), rows)
    assert found.first()["_provenance"] == "right"
    assert ingest.first_valid(spark, [("gone", str(tmp_path / "none"))], gate(3), rows).first()["_provenance"] == "fallback sample"


def test_archives(spark):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in ("p10.png", "p2.png", "__MACOSX/x.png", "a/._p.png", "note.txt", "d/p1.PNG"):
            z.writestr(name, b"x")
    good = buffer.getvalue()
    rows = [("/in/set.zip", good), ("/other/set.zip", good), ("/in/broken.zip", b"no archive"), ("/in/cut.zip", good[: len(good) // 2]), ("/in/none.zip", None)]
    found = ingest.archive_entries(spark.createDataFrame(rows, "path string, content binary")).collect()
    for path in ("/in/set.zip", "/other/set.zip"):
        assert [(r["name"], r["place"]) for r in sorted(found, key=lambda r: r["place"] or 0) if r["path"] == path] == [("set__d__p1.PNG", 1), ("set__p2.png", 2), ("set__p10.png", 3)]
    assert {r["path"] for r in found if r["error"]} == {"/in/broken.zip", "/in/cut.zip", "/in/none.zip"}


def test_image_files_and_json(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, body in (("b.png", b"xx"), ("sub/a.JPG", b"y"), ("sub/notes.txt", b"z"), ("c.webp", b"zz")):
        (tmp_path / "in" / name).write_bytes(body)
    found = {r["name"]: r["length"] for r in ingest.image_files(spark, str(tmp_path / "in")).collect()}
    assert found == {"b.png": 2, "sub__a.JPG": 1, "c.webp": 2}
    (tmp_path / "good.json").write_text('[{"a": 1, "b": "x"}, {"a": 2}]')
    (tmp_path / "bad.json").write_text('[{"a": 1,')
    assert [(r["a"], r["b"]) for r in ingest.read_json(spark, str(tmp_path / "good.json"), "a int, b string").collect()] == [(1, "x"), (2, None)]
    with pytest.raises(Exception):  # noqa: B017  whatever Spark raises for malformed input
        ingest.read_json(spark, str(tmp_path / "bad.json"), "a int, b string").collect()


def test_refresh(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s1"), ("b", "s1")], "name string, slug string")
    gate = lambda df: ingest.require(df, "name", "slug", 2, {"s1": 2})
    path, tried = str(tmp_path / "roster"), []

    def fetch(good):
        def run(attempt):
            tried.append(attempt)
            return rows if attempt in good else rows.limit(1)

        return run

    with pytest.raises(ingest.GateError):
        ingest.refresh(spark, fetch([]), path, gate, pause=0)
    done, said = ingest.refresh(spark, fetch([1]), path, gate, pause=0)
    assert tried == [0, 1, 0, 1] and done.count() == 2 and said == "updated: 2 rows"
    kept, said = ingest.refresh(spark, fetch([]), path, gate, pause=0)
    assert kept.count() == 2 and said.startswith("update failed: 1 rows of 2") and said.endswith("2 rows kept")


def test_arrivals_equal_one_batch(spark, tmp_path):
    from rowloom.streaming import groups

    rows = [(i, f"g{i % 4}", i * 7 % 10) for i in range(40)] + [(100, None, 1)]
    schema = "id long, g string, v long"
    table = spark.createDataFrame(rows, schema)
    build = lambda df: df.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    path = str(tmp_path / "kept")
    steps = [rows[:10], [*rows[8:20], rows[40]], [r for r in rows[20:40] if r[1] == "g1"], rows[:5]]
    for number, step in enumerate(steps):
        batch = spark.createDataFrame(step, schema)
        groups.absorb(batch, number, path, ["id"], "g", build)
        if number == 1:  # a batch that is run again changes nothing
            groups.absorb(batch, number, path, ["id"], "g", build)
    got = {r["g"]: (r["n"], r["s"], r["version"]) for r in groups.results(spark, path, "g", build(table).schema).collect()}
    seen = {r[0]: r for s in steps for r in s}.values()
    want = {g: (sum(1 for r in seen if r[1] == g), sum(r[2] for r in seen if r[1] == g)) for g in {r[1] for r in seen}}
    assert {g: x[:2] for g, x in got.items()} == want
    assert {g: x[2] for g, x in got.items()} == {"g0": 1, "g1": 2, "g2": 1, "g3": 1, None: 1}


def test_compatibility_of_stacked_marks_and_jamo(spark):
    import random
    import unicodedata

    rnd = random.Random(1)
    marks = [chr(c) for c in range(0x300, 0x345) if c != 0x34F] + ["\u3099", "\u309a", "\u0591", "\u05b0", "\u0e38", "\uff9e", "\uff9f"]
    letters = [*"abceoAEO가각한ㄱかはカ①㈱ﬁ½ ", "\uff8c", "\u1112\u1161\u11ab", "\u1100\u1161", "\u1161", "\uac00\u11a8", "\uac01\u11a8", "\u1112", "\u11a8"]
    words = ["".join(rnd.choice(letters) + "".join(rnd.choice(marks) for _ in range(rnd.choice([0, 0, 0, 1, 2, 3]))) for _ in range(rnd.randint(1, 4))) for _ in range(1500)]
    table = spark.createDataFrame([(w,) for w in [*words, "", None]], "w string")
    for r in table.select("w", text.nfkc(F.col("w")).alias("n")).collect():
        assert r["n"] == (None if r["w"] is None else unicodedata.normalize("NFKC", r["w"]))


def test_row_text(spark):
    rows = [("投 右 山田 太郎 21歳 右/左 Ａ", ""), ("一 二 三", "x 鈴木 一"), ("", ""), (None, None), ("20", "20")]
    table = spark.createDataFrame(rows, "a string, b string").select(text.row_text(F.col("a"), F.col("b")).alias("r")).select("r.*")
    got = [(r["age"], r["hand"], r["pos"], r["name"], r["names"]) for r in table.collect()]
    assert got[0] == ("21", "右/左", "投", "山田 太郎", ["山田 太郎"])
    assert got[1] == ("", "", "一", "鈴木 一", ["鈴木 一", "二 三"])
    assert got[2][:4] == ("", "", "", "") and got[3][4] == [] and got[4][0] == "20"


def letters(seed, dark=False):
    rng = np.random.default_rng(seed)
    image = np.full((45, 340), 30 if dark else 220, np.uint8)
    for i in range(8):
        image[10:34, 45 + i * 18 : 57 + i * 18] = np.where(np.kron(rng.random((4, 4)) > 0.5, np.ones((6, 3))) > 0, 230 if dark else 40, image[0, 0])
    return image


def test_masks():
    a, b, other, blank = kernels.row_mask(letters(1)), kernels.row_mask(letters(1, dark=True)), kernels.row_mask(letters(2)), kernels.row_mask(np.full((45, 340), 99, np.uint8))
    assert kernels.mask_match(a, b) > 0.85 and kernels.mask_match(a, other) < kernels.mask_match(a, b) - 0.05
    assert not blank.any() and kernels.mask_match(a, blank) == 0


def test_locate():
    rng = np.random.default_rng(3)
    image = np.full((120, 200), 96.0)
    points = np.stack([rng.integers(0, 30, 64), rng.integers(0, 20, 64), rng.integers(0, 255, 64)], 1).astype(float)
    for x, y, g in points:
        image[int(40 + y * 1.5) : int(40 + y * 1.5) + 2, int(70 + x * 1.5) : int(70 + x * 1.5) + 2] = g
    score, x, y, s = kernels.locate(image, points[::2], points, np.array([1.5]), step=2)
    assert score > 0.8 and abs(x - 70) <= 3 and abs(y - 40) <= 3


def test_panel_and_pitch():
    image = np.full((200, 480), 200, np.uint8)
    image[20:120, 40:400] = 20
    x, y, w, h = kernels.panel(image)
    assert abs(x - 40) <= 4 and abs(y - 20) <= 4 and abs(w - 360) <= 8 and abs(h - 100) <= 8
    assert kernels.panel(np.full((50, 50), 200, np.uint8)) == (0, 0, 50, 50)
    profile = (np.arange(600) % 40 < 12) * 50.0
    assert kernels.row_pitch(profile)[0] == 40
