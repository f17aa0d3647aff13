"""The best records for names as read: blocks of different questions meet blocks of the roster in tasks, which compare each different name once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowloom.operators.vectors import rounded
from rowloom.operators.written import written

#: What agreeing facts add to a score: hand, position, age (fixed values).
FACTS = (0.055, 0.04, 0.008)


#: Numbers that a task keeps of what it has compared, in each of its stores.
KEPT = 8_000_000


class _Texts:
    """Different texts, compared with one reading at a time."""

    def __init__(self, texts: list[str]):
        self.texts = sorted(set(texts))
        at = {t: i for i, t in enumerate(self.texts)}
        self.of = np.array([at[t] for t in texts], np.int64)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.codes = np.full((self.sizes.max(initial=0), len(self.texts)), -1, np.int32)
        for i, t in enumerate(self.texts):
            self.codes[: len(t), i] = [ord(c) for c in t]
        self.held: dict[str, np.ndarray] = {}
        self.at: dict[str, np.ndarray] = {}
        self.known: dict[str, np.ndarray] = {}

    def _kept(self, store: dict[str, np.ndarray], of: str, made: Callable[[str], np.ndarray]) -> np.ndarray:
        if of not in store:
            if (len(store) + 1) * len(self.texts) > KEPT:
                store.clear()
            store[of] = made(of)
        return store[of]

    def like(self, read: str) -> np.ndarray:
        """text.name_similarity() of the reading with every text."""
        return self._kept(self.known, read, self._like)

    def _like(self, read: str) -> np.ndarray:
        if not read or not len(self.codes):
            return np.zeros(len(self.texts))
        edits = self._edits(read) if len(self.codes) <= 64 else self._long_edits(read)
        common = np.zeros(len(self.texts), np.int64)
        for c in set(read):
            common += np.minimum(read.count(c), self._kept(self.held, c, lambda c: (self.codes == ord(c)).sum(axis=0)))
        found = (1 - edits / np.maximum(self.sizes, len(read))) * 0.72 + 2 * common / (self.sizes + len(read)) * 0.28
        return np.where(self.sizes > 0, np.maximum(0.0, found), 0.0)

    def _places(self, c: str) -> np.ndarray:
        """A bit for each place of each text that holds the character."""
        bits = np.zeros(len(self.texts), np.uint64)
        for i, line in enumerate(self.codes):
            bits |= (line == ord(c)).astype(np.uint64) << np.uint64(i)
        return bits

    def _edits(self, read: str) -> np.ndarray:
        """Edit distances to texts of up to 64 characters, a column of the table in two words (Myers and Hyyrö)."""
        one, last = np.uint64(1), np.maximum(self.sizes - 1, 0).astype(np.uint64)
        up, down, edits = np.full(len(self.texts), ~np.uint64(0)), np.zeros(len(self.texts), np.uint64), self.sizes.copy()
        for c in read:
            same = self._kept(self.at, c, self._places)
            level = (((same & up) + up) ^ up) | same
            more, less = down | ~(level | up), up & level
            edits += ((more >> last) & one).astype(np.int64) - ((less >> last) & one).astype(np.int64)
            more, less, same = (more << one) | one, less << one, same | down
            up, down = less | ~(same | more), more & same
        return edits

    def _long_edits(self, read: str) -> np.ndarray:
        step = np.arange(len(self.codes) + 1, dtype=np.int32)[:, None]
        row = np.repeat(step, len(self.texts), axis=1)
        for i, c in enumerate(read, 1):
            new = np.empty_like(row)
            new[0] = i
            np.minimum(row[:-1] + (self.codes != ord(c)), row[1:] + 1, out=new[1:], casting="unsafe")
            row = np.minimum.accumulate(new - step, axis=0) + step
        return row[self.sizes, np.arange(len(self.texts))]


def _most(texts: _Texts, reads: list[str]) -> np.ndarray:
    found = [texts.like(r) for r in reads]
    return np.max(found, axis=0) if found else np.zeros(len(texts.texts))


#: What a question asks of names, and of what else a record holds.
NAMED = ("names", "families", "givens", "r_family", "r_given")
OTHERS = ("r_position", "r_hand", "r_age", "position", "hand", "short", "family_length", "given_length")


def _matching(top: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The function of one task: the ``top`` records of a block for each question of a block."""

    def met(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        held = held.sort_by([("family", "ascending"), ("given", "ascending"), ("uid", "ascending")])
        families, givens = held.column("family").to_pylist(), held.column("given").to_pylist()
        starts = [0] + [i for i in range(1, len(families)) if families[i] != families[i - 1] or givens[i] != givens[i - 1]]
        ends = np.append(starts[1:], len(families))
        starts = np.array(starts)
        family, given = _Texts([families[i] for i in starts]), _Texts([givens[i] for i in starts])
        full = _Texts([families[i] + givens[i] for i in starts])
        lengths = family.sizes[family.of], given.sizes[given.of]
        uid = held.column("uid").to_numpy()
        numbers: dict[str, dict[str, int]] = {c: {} for c in ("position", "hand")}
        position, hand = (np.array([numbers[c].setdefault(v, len(numbers[c])) for v in held.column(c).to_pylist()], np.int64) for c in numbers)
        age = np.array([-1 if a is None else a for a in held.column("age").to_pylist()], np.int64)
        place = {f: i for i, f in enumerate(family.texts)}

        def named(q: dict) -> tuple[np.ndarray, ...]:
            """How every name is like the one read, what its length takes off, and the names by what both leave, best first."""
            sur, giv = _most(family, q["families"])[family.of], _most(given, q["givens"])[given.of]
            weight = (0.54 if q["families"] else 0.0) + (0.46 if q["givens"] else 0.0)
            like = np.maximum(_most(full, q["names"])[full.of], (sur * 0.54 + giv * 0.46) / (weight or 1.0))
            off = [np.where(np.abs(n - len(r)) > 1, 0.06, 0.0) if r else np.zeros(len(n)) for n, r in zip(lengths, (q["r_family"], q["r_given"]), strict=True)]
            least = like * 0.88 - off[0] - off[1]
            return sur, giv, like, *off, least, np.argsort(-least, kind="stable")

        def best(q: dict, sur: np.ndarray, giv: np.ndarray, like: np.ndarray, off_family: np.ndarray, off_given: np.ndarray, least: np.ndarray, names: np.ndarray) -> list[tuple]:
            ok = np.ones(len(starts), bool)
            if q["short"] is not None:
                listed = np.zeros(len(family.texts), bool)
                listed[[place[f] for f in q["short"] if f in place]] = True
                ok &= listed[family.of]
            for n, wanted in zip(lengths, (q["family_length"], q["given_length"]), strict=True):
                if wanted is not None:
                    ok &= np.abs(n - wanted) <= 1
            names = names[ok[names]]
            number = lambda c, v: numbers[c].get(v, -1) if v else -1
            agreeing = ((hand, number("hand", q["r_hand"])), (position, number("position", q["r_position"])))
            rows, scores, done, step = np.zeros(0, np.int64), np.zeros(0), 0, 8
            of = np.zeros(0, np.int64)
            while done < len(names):
                some = names[done : done + step]
                size = ends[some] - starts[some]
                n = np.repeat(some, size)
                i = np.repeat(starts[some] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(len(n))
                inside = np.ones(len(i), bool)
                for c, values in (("position", position), ("hand", hand)):
                    if q[c] is not None:
                        inside &= values[i] == numbers[c].get(q[c], -1)
                i, n = i[inside], n[inside]
                same = [values[i] == r for values, r in agreeing]
                same.append(age[i] == q["r_age"] if q["r_age"] is not None else np.zeros(len(i), bool))
                bonus = np.where(same[0], FACTS[0], 0.0) + np.where(same[1], FACTS[1], 0.0) + np.where(same[2], FACTS[2], 0.0)
                total = rounded(like[n] * 0.88 + bonus - off_family[n] - off_given[n], 8)
                rows, scores, of = np.append(rows, i), np.append(scores, total), np.append(of, n)
                order = np.lexsort((uid[rows], -scores))[:top]
                rows, scores, of = rows[order], scores[order], of[order]
                done, step = done + step, step * 2
                # names that follow can't reach the last place even if every fact agrees
                if len(rows) == top and done < len(names) and least[names[done]] + sum(FACTS) + 1e-7 < scores[-1]:
                    break
            meta = [sum(int(values[i] == r) for values, r in agreeing) for i in rows]
            return [(int(uid[i]), float(s), float(like[n]), float(sur[n]), float(giv[n]), m) for i, s, n, m in zip(rows, scores, of, meta, strict=True)]

        out, last, known = [], None, ()
        for q in sorted(asked.to_pylist(), key=lambda q: (repr(q["names"]), q["name_ask"])):
            if q["name_ask"] != last:
                last, known = q["name_ask"], named(q)
            out += [(q["ask"], *found) for found in best(q, *known)]
        return pa.Table.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return met


def _digest(columns: tuple[str, ...]) -> Column:
    """What tells different values of the columns apart, null from empty too."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def best_named(reads: DataFrame, roster: DataFrame, key: str, top: int = 1, read_block: int = 20_000, row_block: int = 400_000, least_blocks: int = 32) -> DataFrame:
    """The ``top`` records of each reading that its gates leave, with their ``place``: key, uid, score, name, sur, giv, meta.

    reads: the key (a long), names, families and givens (arrays: what was read, by itself or by parts), r_family, r_given, r_position, r_hand,
    r_age, and the gates of gates.narrowed(), null where not taken: position, hand, ``short`` (the shortlist), family_length, given_length.
    roster: uid (a long), family, given, position, hand, age. The score is match.text_total() of the likeness by the whole name or by its
    parts; name, sur and giv are those, meta how many of hand and position agree. Ties go to the smaller uid.

    Readings that ask the same are one question, and records alike in name and facts are one to it but for their ``top`` smallest uids: so work
    grows with different questions and different names, not with readings and records. Questions alike in their names fall in one block, records of one name in one block. A task compares each different reading and name once, and looks at records name by name, best
    names first, until those that follow can't be among the best even if all facts agree. So no pair of a question and a record is ever shuffled but the best of a block.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = roster.select(F.col("uid").cast("long").alias("uid"), text("family"), text("given"), text("position"), text("hand"), F.col("age").cast("long").alias("age"))
    alike = Window.partitionBy("family", "given", "position", "hand", "age").orderBy("uid")
    rows = written(rows.withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= top).drop("_n"), "alike-records")
    q = reads.select(key, *[F.col(c).cast("long").alias(c) if c == "r_age" else c for c in (*NAMED, *OTHERS)])
    q = written(q.withColumns({"name_ask": _digest(NAMED), "ask": _digest((*NAMED, *OTHERS))}), "readings")
    questions = written(q.groupBy("ask").agg(*[F.first(c).alias(c) for c in ("name_ask", *NAMED, *OTHERS)]), "questions")
    n_names, n_rows = questions.select("name_ask").distinct().count(), rows.count()
    held = max(1, -(-n_rows // row_block))
    asked = max(1, -(-n_names // read_block), min(-(-n_names // 50), -(-least_blocks // held)))
    cell = (F.col("_q") * held + F.col("_r")).cast("int").alias("_cell")
    block = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = questions.withColumn("_q", block(asked, "name_ask")).withColumn("_r", every(held)).select(cell, *questions.columns)
    right = rows.withColumn("_r", block(held, "family", "given")).withColumn("_q", every(asked)).select(cell, *rows.columns)
    double = [T.StructField(c, T.DoubleType()) for c in ("score", "name", "sur", "giv")]
    schema = T.StructType([T.StructField("ask", T.StringType()), T.StructField("uid", T.LongType()), *double, T.StructField("meta", T.IntegerType())])
    tasks = 3 * asked * held
    met = _matching(top, to_arrow_schema(schema))
    found = left.repartition(tasks, "_cell").groupBy("_cell").cogroup(right.repartition(tasks, "_cell").groupBy("_cell")).applyInArrow(met, schema)
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), "uid")
    found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    return q.select(key, "ask").join(found, "ask").drop("ask")
