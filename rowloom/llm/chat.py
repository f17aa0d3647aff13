"""Reply trees as conversations: root-to-leaf paths by self-joins, ranked branches, one text each.

A message answers another one of its tree. Self-joins that double their reach find the ancestors
of every leaf in as many rounds as the depth has binary digits; paths hold ids only until the best
branches of each tree are chosen, and then each chosen path is written as one conversation.

The template marks turns::

    <<SYS>>\\n{system}\\n<</SYS>>\\n\\n   [INST] {user} [/INST]   {assistant} </s>   [ROLE]{other, as JSON}\\n{text} [/ROLE]

Inside texts every backslash is doubled and every control string gets a backslash after its
first sign, so that no control string is left in a text and removing the backslashes restores it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import staged

#: Control strings of the template (fixed values).
CONTROLS = ("<<SYS>>", "<</SYS>>", "[/INST]", "[INST]", "[/ROLE]", "[ROLE]", "</s>", "<s>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n\n|\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE\](?P<name>[^\n]*)\n(?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation of (role, text), and the spans in it that a loss counts: the escaped assistant texts."""
    out, mask, at = [], [], 0
    for role, text in turns:
        inner = escape(text)
        if role == "system":
            before, after = "<<SYS>>\n", "\n<</SYS>>\n\n"
        elif role == "user":
            before, after = "[INST] ", " [/INST]"
        elif role == "assistant":
            before, after = " ", " </s>"
            mask.append((at + 1, at + 1 + len(inner)))
        else:
            before, after = f"[ROLE]{json.dumps(escape(role))}\n", " [/ROLE]"
        out += [before, inner, after]
        at += len(before) + len(inner) + len(after)
    return "".join(out), mask


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; what doesn't follow the template is an error."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = next(k for k in ("system", "user", "assistant", "other") if m[k] is not None)
        turns.append((unescape(json.loads(m["name"])) if kind == "other" else kind, unescape(m[kind])))
        at = m.end()
    return turns


# ---- trees


def _same(a: str, b: str) -> Column:
    """Join condition on the tree, where null is a tree of its own."""
    return F.col(a).eqNullSafe(F.col(b))


def jump_tables(spine: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables of (tree, node, to), ``to`` being the ancestor 1, 2, 4, ... steps up; and the nodes without a root, if any.

    Round k joins the table of 2^k steps with itself. It ends when no ancestor is so far up, or
    when the reach is past the number of nodes: what still finds one then is on or below a cycle.
    """
    up = spine.filter("parent is not null").join(spine.select(F.col("tree").alias("_t"), F.col("node").alias("_n")), _same("tree", "_t") & (F.col("parent") == F.col("_n")), "left_semi")
    tables = [staged(up.select("tree", "node", F.col("parent").alias("to")), "tree-jumps")]
    nodes, reach = spine.count(), 1
    while not tables[-1].isEmpty():
        if reach >= nodes:
            return tables, tables[-1].select("tree", "node")
        last = tables[-1]
        far = last.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("to").alias("_far"))
        tables.append(staged(last.join(far, _same("tree", "_t") & (F.col("to") == F.col("_n"))).select("tree", "node", F.col("_far").alias("to")), "tree-jumps"))
        reach *= 2
    return tables[:-1], None


def root_paths(spine: DataFrame) -> DataFrame:
    """Every root-to-leaf path: tree, leaf, node, ``up`` (steps from the leaf).

    spine: tree, node, parent, each node once. A parent that isn't there makes its child a root.
    Nodes on or below a cycle have no root and stand in no path.
    """
    tables, lost = jump_tables(spine)
    answered = tables[0] if tables else None
    leaves = spine.select("tree", "node")
    for gone, node in ((answered, "to"), (lost, "node")):
        if gone is not None:
            leaves = leaves.join(gone.select(F.col("tree").alias("_t"), F.col(node).alias("_n")), _same("tree", "_t") & (F.col("node") == F.col("_n")), "left_anti")
    paths = staged(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "tree-paths")
    for k, jump in enumerate(tables):
        far = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("to").alias("_far"))
        more = paths.join(far, _same("tree", "_t") & (F.col("node") == F.col("_n"))).select("tree", "leaf", F.col("_far").alias("node"), (F.col("up") + 2**k).alias("up"))
        paths = paths.union(staged(more, "tree-paths"))
    return paths


def best_paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """The ``top`` root-to-leaf paths of each tree (null: all): tree, leaf, score, rank, turns.

    messages: tree, node, parent, role, text, score; other columns are ignored. A path's score is
    the mean of its messages' scores (null: 0), of equals the smaller leaf comes first;
    ``rank`` is null where all paths are taken. ``turns`` are structs of up (steps from the leaf),
    role and text, in any order. Null texts and roles are empty ones, a null tree is a tree, a
    null parent makes a root; null nodes of a tree are one node that nothing can answer. Of rows that share
    tree and node the one of the largest score, parent and hash counts. Empty input gives no rows.
    """
    pick = F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    held = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), pick.alias("pick"))
    spine = held.groupBy("tree", "node").agg(F.max(F.struct("score", "parent", "pick")).alias("m")).select("tree", "node", "m.*")
    spine = staged(spine, "tree-spine")
    paths = root_paths(spine.select("tree", "node", "parent"))
    known = spine.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "score", "pick")
    scored = paths.join(known, _same("tree", "_t") & _same("node", "_n")).drop("_t", "_n")
    per = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    if top is None:
        per = per.withColumn("rank", F.lit(None).cast("int"))
    else:
        order = Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf")
        per = per.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    steps = scored.drop("score").join(per.withColumnsRenamed({"tree": "_t", "leaf": "_l"}), _same("tree", "_t") & _same("leaf", "_l")).drop("_t", "_l")
    texts = held.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("pick").alias("_p"), "role", "text")
    full = steps.join(texts, _same("tree", "_t") & _same("node", "_n") & (F.col("pick") == F.col("_p")))
    return full.groupBy("tree", "leaf", "score", "rank").agg(F.collect_list(F.struct("up", "role", "text")).alias("turns"))


MASK = "array<struct<start:long,end:long>>"


def format_paths(paths: DataFrame) -> DataFrame:
    """The paths of best_paths() without ``turns``, with ``formatted`` and ``mask``, its spans under the loss in code points.

    A conversation is one text in one row, so each has to fit a task. Rows repeated in a path count once.
    """
    kept = [c for c in paths.columns if c != "turns"]
    mask_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for turns in batch.column("turns").to_pylist():
                ordered = {t["up"]: (t["role"], t["text"]) for t in sorted(turns, key=lambda t: (-t["up"], t["role"], t["text"]))}
                made.append(formatted(list(ordered.values())))
            spans = [[{"start": s, "end": e} for s, e in mask] for _, mask in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([t for t, _ in made], pa.string()), pa.array(spans, mask_type)], [*kept, "formatted", "mask"])

    schema = ", ".join(f"{c} {paths.schema[c].dataType.simpleString()}" for c in kept)
    return paths.mapInArrow(run, f"{schema}, formatted string, mask {MASK}")


def read_back(conversations: DataFrame) -> DataFrame:
    """Formatted conversations with their ``turns`` (array of role and text) and ``loss_texts`` (what lies under the mask, unescaped); nulls for a null text."""
    kept = conversations.columns
    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, masks = batch.column("formatted").to_pylist(), batch.column("mask").to_pylist()
            turns = [None if t is None else [{"role": r, "text": x} for r, x in parsed(t)] for t in texts]
            loss = [None if t is None else [unescape(t[s["start"] : s["end"]]) for s in mask or ()] for t, mask in zip(texts, masks, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turns, turn_type), pa.array(loss, pa.list_(pa.string()))], [*kept, "turns", "loss_texts"])

    schema = ", ".join(f"{c} {conversations.schema[c].dataType.simpleString()}" for c in kept)
    return conversations.mapInArrow(run, f"{schema}, turns array<struct<role:string,text:string>>, loss_texts array<string>")


def as_trees(conversations: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role and text as messages of trees: each answers the one before; scored by length.

    Rows go by turn, null first, equal ones by role and text. Other columns are ignored.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").alias("score"))


def _escaped_length() -> str:
    """SQL: code points of an escaped ``text``."""
    quoted = [f"(len(text) - len(replace(text, '{c}', ''))) // {len(c)}" for c in CONTROLS]
    return " + ".join(["len(text)", r"(len(text) - len(replace(text, '\', '')))", *quoted])


CHAT_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM (SELECT unnest([0, 1]) AS i)),
n AS (SELECT *, {_escaped_length()} + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 END AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
