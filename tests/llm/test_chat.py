"""Reply trees: escapes, paths by brute force, ranks, edge rows, the SQL."""

import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.llm import chat
from rowloom.llm.queries import op11_reply_trees

SIGNS = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "[", "]", "<", ">", "/", " ", "\n", "INST", "s", "é", "😀"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "a\n[/ROLE]\"\\"]), SIGNS), max_size=6))
def test_round_trip(turns):
    text, mask = chat.formatted(turns)
    assert chat.parsed(text) == turns
    assert [chat.unescape(text[s:e]) for s, e in mask] == [t for r, t in turns if r == "assistant"]
    marks = sum({"system": 2, "user": 2, "assistant": 1}.get(r, 2) for r, _ in turns)
    assert len(chat._CONTROL.findall(text)) == marks


def slow_paths(rows):
    nodes = {(t, n): p for t, n, p, *_ in rows}
    parents = {(t, p) for (t, n), p in nodes.items() if (t, p) in nodes and p is not None}
    out = {}
    for t, n in nodes:
        if (t, n) in parents:
            continue
        path, at = [], (t, n)
        while at in nodes and at not in path:
            path.append(at)
            at = (t, nodes[at]) if nodes[at] is not None else None
        if at not in path:
            out[(t, n)] = [x[1] for x in path][::-1]
    return out


def test_paths(spark):
    rnd = random.Random(5)
    rows = []
    for tree in (1, 2, None):
        for node in range(60):
            parent = rnd.choice([None, *range(max(0, node - 4), node), *range(max(0, node - 4), node)]) if node else None
            rows.append((tree, node, parent, rnd.choice(["user", "assistant"]), f"t{node}", rnd.random(), 7))
    rows += [(3, i, i - 1 if i else None, "user", str(i), 0.5, 7) for i in range(300)]  # one deep chain
    rows += [(4, 1, 2, "user", "a", 1.0, 7), (4, 2, 1, "user", "b", 1.0, 7), (4, 3, 1, "user", "below a cycle", 1.0, 7), (4, 9, 8, "user", "orphan", None, 7)]
    rows += [(5, None, None, None, None, None, 7), (5, 1, None, "user", "x", 1.0, 7), (5, 1, None, "user", "x", 1.0, 7), (5, 1, None, "user", "worse", 0.5, 7)]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double, leaf int")
    got = {(r["tree"], r["leaf"]): r for r in chat.format_paths(chat.best_paths(messages, top=None)).collect()}
    unique = [r for r in rows if r[4] != "worse"]
    want = slow_paths(unique)
    assert got.keys() == want.keys()
    texts = {(r[0], r[1]): (r[3] or "", r[4] or "") for r in unique}
    for key, path in want.items():
        assert chat.parsed(got[key]["formatted"]) == [texts[key[0], n] for n in path]
    scores = {(r[0], r[1]): r[5] or 0.0 for r in unique}
    best = chat.best_paths(messages, top=2).collect()
    for tree in {k[0] for k in want}:
        ranked = sorted((-sum(scores[tree, n] for n in p) / len(p), -1 if leaf is None else leaf) for (t, leaf), p in want.items() if t == tree)[:2]
        mine = sorted((r["rank"], r["leaf"]) for r in best if r["tree"] == tree)
        assert [-1 if leaf is None else leaf for _, leaf in mine] == [leaf for _, leaf in ranked]
    assert chat.best_paths(messages.limit(0)).count() == 0


def test_query(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = con.execute(chat.CHAT_SQL).df().set_index("conv_id").sort_index()
    got = op11_reply_trees(spark, "/root/testdata/sf0.01").toPandas().set_index("conv_id").sort_index()
    assert got.index.is_unique and (got[want.columns] == want).all().all()


def test_unordered_rows(spark, tmp_path):
    rows = [(1, None, "user", "late"), (1, 0, None, None), (None, 3, "assistant", "x\\"), (2, 1, "user", "same"), (2, 1, "user", "same")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op11_reply_trees(spark, str(tmp_path)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 2, None: 1, 2: 2, -7: 2}
    assert got[None]["loss_chars"] == 2 and got[-7]["loss_chars"] == len("</s>[INST] ok [/INST]")
