"""Near duplicates by the exact Jaccard similarity of word shingles, 0.8 or more, with a candidate search that loses none.

Fingerprints in one ball (``simhash``) make candidates, but most pairs at 0.8 lie beyond its
radius, so shared shingles make candidates as well. Two sets at 0.8 share at least four fifths
of either. Sorted by hash, a set's first n/5 + l elements therefore hold l elements that the
first n/5 + l of the other hold too (prefix filter). Each set keeps the first n/5 + 1 + n/8 and
goes on only where enough of them stand in a different set as well, which a common line alone
doesn't reach. Sets left are grouped by chains of either kind, and each group's true links are
found over whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import spread_join, staged, unstage
from rowloom.llm.components import components
from rowloom.llm.simhash import fingerprint_of, links, shingle_hashes


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; empty without words."""
    return np.unique(shingle_hashes(text, shingle).astype(np.uint64))


def kept_length(n: int) -> int:
    """Elements of a set of ``n`` that take part in the search; a set at 0.8 shares 1 + (n - n // 5) // 8 of them or more."""
    return min(n, n // 5 + 1 + n // 8)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Batches cut small, as a row's shingles take several times the memory of its text."""
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)


class _Holders:
    """Which of ``members`` hold each element."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        self.members = members
        sizes = np.array([len(sets[m]) for m in members])
        flat = np.concatenate([sets[m] for m in members])
        order = np.argsort(flat)
        flat = flat[order]
        first = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.zeros(0, bool)
        self.elements, self.starts = flat[first], np.append(np.flatnonzero(first), len(flat))
        self.holders = np.repeat(np.arange(len(members), dtype=np.int32), sizes)[order]

    def shared(self, mine: np.ndarray) -> np.ndarray:
        """How many elements of ``mine`` each member holds."""
        if not len(self.elements):
            return np.zeros(len(self.members), np.int64)
        at = np.minimum(np.searchsorted(self.elements, mine), len(self.elements) - 1)
        at = at[self.elements[at] == mine]
        lengths = self.starts[at + 1] - self.starts[at]
        picked = np.repeat(self.starts[at] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return np.bincount(self.holders[picked], minlength=len(self.members))


def spanning_links(keys: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links at 0.8 or more that connect what all such links connect: a breadth-first walk over sets not yet reached.

    The index holds the sets not yet reached, and is made anew whenever half of them are gone.
    """
    sizes = np.array([len(s) for s in sets])
    index, open_ = _Holders(sets, np.arange(len(sets))), np.ones(len(sets), bool)
    queue: list[int] = []
    found = []
    first = 0
    while open_.any():
        if not queue:
            while not open_[first]:
                first += 1
            open_[first], queue = False, [first]
        if 2 * open_[index.members].sum() < len(index.members):
            index = _Holders(sets, np.flatnonzero(open_)) if open_.any() else index
        at = queue.pop()
        near = open_[index.members] & (9 * index.shared(sets[at]) >= 4 * (sizes[at] + sizes[index.members]))
        reached = index.members[near]
        found += [(keys[at], keys[x]) for x in reached.tolist()]
        queue += reached.tolist()
        open_[reached] = False
    return found


def _linked(group: pa.Table) -> pa.Table:
    sets = dict(zip(group.column("key").to_pylist(), (np.frombuffer(v.as_buffer(), np.uint64) for v in group.column("hashes")), strict=True))
    found = spanning_links(list(sets), list(sets.values()))
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _least():
    """How many searched elements a set of n shares with any at 0.8 at least."""
    return 1 + F.expr("(n - n div 5) div 8")


def chains_of(held: DataFrame, what: str = "key") -> DataFrame:
    """Links (a, b) between the keys that stand at one element of ``held`` (key, element), where those differ in ``what``."""
    hubs = held.groupBy("element").agg(F.min("key").alias("low"), F.min(what).alias("_x"), F.max(what).alias("_y"), F.count("*").alias("holders")).filter("_x <> _y").select("element", "low", "holders")
    return spread_join(held, hubs, ["element"], "holders", F.col("key")).select(F.col("low").alias("a"), F.col("key").alias("b"))


def verified(cut: DataFrame, searched: DataFrame, shingled: Callable[[DataFrame], DataFrame], at_once: int) -> DataFrame:
    """Links (a, b) at 0.8 or more between sets (group, parts, part, key, n) of one group, enough to connect what all such links connect.

    shingled: adds the ``hashes`` of the sets; searched: (key, element), what they are searched by.

    No task compares more than about twice ``at_once`` elements. Groups within that are one
    task each. Larger ones are cut at random (into ``parts``): each part is linked, then what stands for
    the parts' components. What is left are links between components: only elements that stand
    in several, and sets that hold enough of these, go on, chained anew. Of such a chain every pair
    of parts is compared whose lengths allow a link: components of more than ``at_once`` elements have parts of their own, the others
    share parts, and pairs within one component are left out.
    """
    schema = "a long, b long"
    parts = F.ceil(F.col("size") / at_once).cast("int")
    links = staged(shingled(cut).groupBy("group", "part").applyInArrow(_linked, schema), "links-in-parts")
    large = cut.filter("parts > 1")
    if large.isEmpty():
        return links
    large = staged(shingled(large).drop("parts", "part"), "large-groups")

    def with_components() -> DataFrame:
        labels = components(links)
        return large.join(labels, F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("label", "key")).drop("node")

    first = with_components().filter("key = label").drop("label")
    sizes = first.groupBy("group").agg(F.sum("n").alias("size"), F.count("*").alias("several")).filter("several > 1")
    first = first.join(sizes.select("group", parts.alias("parts")), "group").withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    links = links.union(staged(first.groupBy("group", "part").applyInArrow(_linked, schema), "links-of-components"))
    now = with_components()
    labels = staged(now.select("key", "n", "label"), "labels-of-groups")
    across = searched.join(labels, "key")
    mixed = across.groupBy("element").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("holders")).filter("low <> high").select("element", "holders")
    across = staged(spread_join(across, mixed, ["element"], "holders", F.col("key")).select("key", "n", "label", "element"), "elements-across")
    open_ = across.groupBy("key", "n").count().filter(F.col("count") >= _least()).select("key")
    chains = chains_of(across.join(open_, "key", "left_semi"), "label")
    again = components(chains.filter("a <> b").distinct()).select(F.col("node").alias("key"), F.col("label").alias("chain"))
    now = staged(now.join(again, "key").drop("group").withColumnRenamed("chain", "group"), "components-of-groups")
    of_label = now.groupBy("group", "label").agg(F.sum("n").alias("weight"), F.max("n").alias("most"))
    of_group = of_label.groupBy("group").agg(F.count("*").alias("several"), F.sum(F.when(F.col("weight") <= at_once, F.col("weight"))).alias("light")).filter("several > 1")
    # sets link only where neither is under four fifths of the other: large groups are cut by length first
    of_label = of_label.join(of_group, "group").withColumn("class", F.when(F.col("light") > at_once, F.floor(F.log(F.col("most").cast("double")) / float(np.log(1.25)))).otherwise(0).cast("int"))
    of_class = of_label.filter(F.col("weight") <= at_once).groupBy("group", "class").agg(F.sum("weight").alias("class_weight"))
    of_label = of_label.drop("light", "several").join(of_class, ["group", "class"], "left")
    heavy = F.col("weight") > at_once
    place = F.when(heavy, F.struct(F.col("label").alias("own"), F.lit(0).alias("class"), F.pmod(F.xxhash64("key"), F.ceil(F.col("weight") / at_once)).cast("int").alias("no")))
    place = place.otherwise(F.struct(F.lit(None).cast("long").alias("own"), F.col("class").alias("class"), F.pmod(F.xxhash64("label"), F.ceil(F.col("class_weight") / at_once)).cast("int").alias("no")))
    placed = staged(now.join(of_label, ["group", "label"]).withColumn("place", place).select("group", "key", "n", "hashes", "place"), "placed-sets")
    places = placed.groupBy("group", "place").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    pairs = places.select("group", F.col("place").alias("x"), F.col("low").alias("low_x"), F.col("high").alias("high_x")).join(places.select("group", F.col("place").alias("y"), F.col("low").alias("low_y"), F.col("high").alias("high_y")), "group")
    key = lambda p: F.struct(F.coalesce(F.col(f"{p}.own"), F.lit(0)), F.col(f"{p}.own").isNull(), F.col(f"{p}.class"), F.col(f"{p}.no"))
    near = (F.col("high_x") * 5 >= F.col("low_y") * 4) & (F.col("high_y") * 5 >= F.col("low_x") * 4)
    pairs = pairs.filter((key("x") <= key("y")) & near & ~F.coalesce(F.col("x.own") == F.col("y.own"), F.lit(False))).withColumn("pair", F.struct("x", "y"))
    of_pair = pairs.select("group", "pair", F.explode(F.array_distinct(F.array("x", "y"))).alias("place"))
    told = placed.drop("n").withColumn("place", F.to_json("place")).join(of_pair.withColumn("place", F.to_json("place")).withColumn("pair", F.to_json("pair")), ["group", "place"])
    return links.union(told.groupBy("group", "pair").applyInArrow(_linked, schema))


def bitmap_of(elements: DataFrame, bits: int = 27) -> np.ndarray:
    """A bitmap of ``2 ** bits`` places in which those of all elements (hashes) are set: 16 MB however many there are.

    The driver gets one row for each 64 places that hold any, 2 million at most.
    """
    place = F.col("element").bitwiseAND(F.lit((1 << bits) - 1))
    words = elements.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(element & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def standing_in(sets: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """key, n and element for the prefix elements of ``sets`` whose place in the bitmap is set: all that are in it, and a share of others."""
    spark = sets.sparkSession
    sent, mask = spark.sparkContext.broadcast(bitmap), np.uint64(len(bitmap) * 64 - 1)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            prefix = batch.column("prefix")
            flat = prefix.flatten().to_numpy(zero_copy_only=False)
            place = flat.view(np.uint64) & mask
            hit = np.flatnonzero((held[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
            row = np.searchsorted(prefix.offsets.to_numpy()[1:] - prefix.offsets[0].as_py(), hit, side="right")
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), batch.column("n").take(pa.array(row)), pa.array(flat[hit])], ["key", "n", "element"])

    return sets.select("key", "n", "prefix").mapInArrow(kept, "key long, n int, element long")


def set_links(docs: DataFrame, sets: DataFrame, shingle: int, narrow: int = 500_000, at_once: int = 2_500_000) -> DataFrame:
    """Links (a, b) between the keys of different sets; ``docs`` has row and text, ``sets`` has row, key, fp, n and prefix."""
    held = sets.select("key", "n", F.explode("prefix").alias("element"))
    # the first 48 bits tell sets apart; equal ones take less room in the shuffle
    start = F.shiftright("key", 16)
    shared = held.groupBy("element").agg(F.min(start).alias("low"), F.max(start).alias("high"), F.count("*").alias("holders")).filter("low <> high")
    shared = staged(shared.select("element", "holders"), "shared-shingles")
    # few of all elements are shared: a bitmap keeps nearly all others out of the shuffle, the join is exact
    near = held.join(F.broadcast(shared.select("element")), "element", "left_semi") if shared.count() < narrow else spread_join(standing_in(sets, bitmap_of(shared)), shared, ["element"], "holders", F.col("key"))
    reach = staged(near.select("key", "n", "element").distinct(), "shared-prefixes")
    enough = staged(reach.groupBy("key", "n").count().filter(F.col("count") >= _least()).select(F.col("key").alias("_k")), "candidate-sets")
    left = staged(reach.join(enough, F.col("key") == F.col("_k"), "left_semi").select("key", "element"), "candidate-prefixes")
    unstage(shared, reach, enough)
    chains = chains_of(left)
    # fingerprints in one ball chain their sets too
    prints = staged(sets.groupBy("fp").agg(F.min("key").alias("low"), F.count("*").alias("holders")), "distinct-fingerprints")
    alike = spread_join(sets.select("fp", "key"), prints, ["fp"], "holders", F.col("key")).select(F.col("low").alias("a"), F.col("key").alias("b"))
    ball = links(prints.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    ball = ball.join(prints.select(F.col("fp").alias("x"), F.col("low").alias("a")), "x").join(prints.select(F.col("fp").alias("y"), F.col("low").alias("b")), "y").select("a", "b")
    groups = components(chains.union(alike).union(ball).filter("a <> b").distinct())
    picked = sets.groupBy("key").agg(F.min("row").alias("row"), F.min("n").alias("n")).join(groups, F.col("key") == F.col("node")).select("row", "key", "n", F.col("label").alias("group"))
    picked = staged(picked, "candidate-rows")
    sizes = picked.groupBy("group").agg(F.ceil(F.sum("n") / at_once).cast("int").alias("parts"), F.count("*").alias("holders"))
    cut = spread_join(picked, sizes, ["group"], "holders", F.col("key")).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    names = ["group", "parts", "part", "key", "n"]
    cut = staged(cut.select("row", *names), "candidate-parts")
    few = cut.count() < narrow

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            values = [shingle_set(t.as_py(), shingle).tobytes() for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(values, pa.binary())], [*names, "hashes"])

    def shingled(some: DataFrame) -> DataFrame:
        """The texts of ``some``: most texts have no candidate, and where those that have are few, none is shuffled."""
        chosen = some.withColumnRenamed("row", "_r")
        texts = docs.join(F.broadcast(chosen) if few else chosen, F.col("row") == F.col("_r")).select(*names, "text")
        return texts.mapInArrow(hashed, "group long, parts int, part int, key long, n int, hashes binary")

    return verified(cut, left, shingled, at_once)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, narrow: int = 500_000, at_once: int = 2_500_000) -> DataFrame:
    """One row per row of ``docs``: doc_id and component_id, the smallest doc_id that links reach.

    Documents link where the Jaccard similarity of their shingle sets is 0.8 or more; sets are
    of 64-bit hashes. Texts without words, null too, link to each other. ``doc_id`` has to tell
    different texts apart. Other columns are ignored. Empty input gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("row"), F.col(text).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            hashes = [shingle_hashes(t.as_py(), shingle) for t in batch.column("text")]
            sets = [np.unique(h.astype(np.uint64)) for h in hashes]
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            prints = np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64)
            # of copies in one task the first stands for all in the search
            first = [s[: 0 if k in seen or seen.add(k) else kept_length(len(s))].view(np.int64) for s, k in zip(sets, keys.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(keys), pa.array(prints), pa.array([len(s) for s in sets], pa.int32()), pa.array(first, pa.list_(pa.int64()))], ["row", "key", "fp", "n", "prefix"])

    kind = rows.schema["row"].dataType.simpleString()
    sets = staged(rows.mapInArrow(hashed, f"row {kind}, key long, fp long, n int, prefix array<long>"), "shingle-sets")
    labels = components(set_links(rows, sets, shingle, narrow, at_once))
    joined = sets.select("row", "key").join(labels, F.col("key") == F.col("node"), "left").select("row", F.coalesce("label", "key").alias("label"))
    joined = staged(joined, "labelled-rows")
    lows = joined.groupBy("label").agg(F.min("row").alias("component_id"))
    return joined.join(lows, "label").select(F.col("row").alias("doc_id"), "component_id")
