"""Approximate nearest neighbours by inner product with a robust-pruned directed graph.

Equal vectors are indexed once. Vectors are dealt to shards by their hash. In each shard an
extra coordinate makes the largest inner product the smallest distance; the graph starts with
random edges, greedy searches from a central node propose neighbours for batches of nodes,
robust pruning keeps a near candidate only where no kept one is much nearer to it, and the
edges are added in reverse too. Every shard is searched with a beam for every query, a batch
of queries side by side, and the shards' candidates are merged by their exact inner product.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import staged


def usable(vector: Column) -> Column:
    """Not null, not all zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _augmented(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to the longest one's length 1, and a coordinate that gives all of them that length."""
    v = vectors / np.sqrt((vectors**2).sum(axis=1).max())
    return np.hstack([v, np.sqrt(np.maximum(0, 1 - (v**2).sum(axis=1)))[:, None]]).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """The ``beam`` best nodes found for each query by largest product, best first, -1 where fewer were reached.

    Every query of the block expands its best node not yet expanded in each round, until the
    whole beam of each is expanded.
    """
    n, q = len(points), len(queries)
    nodes = np.full((q, beam), -1, np.int32)
    near = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    nodes[:, 0], near[:, 0], done[:, 0] = entry, queries @ points[entry], False
    seen = np.zeros((q, n), bool)
    seen[:, entry] = True
    alive = np.arange(q)
    while len(alive):
        pick = np.argmin(done[alive], axis=1)
        todo = ~done[alive, pick]
        alive, pick = alive[todo], pick[todo]
        if not len(alive):
            break
        done[alive, pick] = True
        found = edges[nodes[alive, pick]]
        # -1 stands for no edge; a node may stand once in a row of edges only
        fresh = (found >= 0) & ~seen[alive[:, None], found]
        at, col = np.nonzero(fresh)
        seen[alive[at], found[at, col]] = True
        value = np.full(found.shape, -np.inf, np.float32)
        value[at, col] = np.einsum("ij,ij->i", points[found[at, col]], queries[alive[at]])
        all_near = np.hstack([near[alive], value])
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        near[alive] = np.take_along_axis(all_near, best, 1)
        nodes[alive] = np.take_along_axis(np.hstack([nodes[alive], np.where(fresh, found, -1)]), best, 1)
        done[alive] = np.take_along_axis(np.hstack([done[alive], ~fresh]), best, 1)
    return nodes


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` neighbours of each node: the nearest candidate stays, those that it is nearer to by alpha go, and again."""
    c = np.sort(candidates, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == nodes[:, None]] = -1
    vectors = points[np.maximum(c, 0)]
    own = np.where(c >= 0, ((vectors - points[nodes][:, None]) ** 2).sum(axis=2), np.inf)
    square = (vectors**2).sum(axis=2)
    out = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = own.argmin(axis=1)
        live = np.isfinite(own[rows, best])
        if not live.any():
            break
        out[live, k] = c[rows, best][live]
        chosen = vectors[rows, best]
        between = square + square[rows, best][:, None] - 2 * np.einsum("ijk,ik->ij", vectors, chosen)
        own[alpha**2 * between <= own] = np.inf
        own[rows, best] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int, beam: int, alpha: float, seed: int = 0) -> tuple[np.ndarray, int]:
    """Edges of each node, -1 for none, and the entry node; two rounds, the first with alpha 1."""
    n = len(points)
    rng = np.random.default_rng(seed)
    entry = int(np.argmax(points @ points.mean(axis=0)))
    edges = np.full((n, degree), -1, np.int32)
    if n > 1:
        random = rng.integers(0, n, (n, min(degree, 16)))
        edges = robust_prune(points, np.arange(n), np.hstack([random, np.full((n, 1), entry)]), degree, 1.0)
    for relaxed in (1.0, alpha):
        order = rng.permutation(n)
        size = max(64, min(1024, 4_000_000 // max(n, 1)))
        for s in range(0, n, size):
            part = order[s : s + size]
            found = beam_search(points, edges, entry, points[part], beam)
            edges[part] = robust_prune(points, part, np.hstack([found, edges[part]]), degree, relaxed)
            # reverse edges: free places take them, full rows are pruned anew
            source = np.repeat(part, degree)
            target = edges[part].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            first = np.flatnonzero(np.diff(target, prepend=-1))
            place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
            hit = target[first]
            width = int(place.max()) + 1 if len(place) else 0
            extra = np.full((len(hit), width), -1, np.int32)
            extra[np.searchsorted(hit, target), place] = source
            for t in range(0, len(hit), 2048):
                some = hit[t : t + 2048]
                for w in range(0, width, 64):  # very popular nodes take their reverse edges in turns
                    more = extra[t : t + 2048, w : w + 64]
                    use = (more >= 0).any(axis=1)
                    if use.any():
                        edges[some[use]] = robust_prune(points, some[use], np.hstack([edges[some[use]], more[use]]), degree, relaxed)
    return edges, entry


def nearest(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", degree: int = 32, beam: int = 96, alpha: float = 1.2, least_shards: int = 8, shard_size: int = 50_000, heavy: int = 10_000) -> DataFrame:
    """query_id, rank, vec_id, score and query_key: each query's ``k`` nearest found, its own row left out.

    queries: which rows of ``vectors`` are queries. Vectors that are null, zero, or hold null or
    non-finite components take no part, and vectors of another length than the query's are no
    candidates of it. Equal scores rank by vec_id, null last. Rows that repeat a vec_id stand apart as
    candidates; as queries they count once where they agree in the vector, and else have their
    own results, told apart by query_key, the vector's hash. Other columns are ignored. Fewer than ``k`` candidates give fewer rows; an empty table gives none. Shards hold
    about ``shard_size`` vectors of one length, but a length has ``least_shards`` shards at least.
    A task holds one shard at a time and lets the queries pass by in batches. Queries that share
    one vector are searched once; beyond ``heavy`` of them, their results are dealt to several tasks.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = staged(rows.filter(usable(F.col("v"))).withColumn("key", F.sha2(F.to_json(F.struct("v")), 256)), "vectors")
    # of equal vectors only the smallest ids can be among the nearest; one more for the query's own
    same = Window.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
    in_turn = F.array_sort(F.collect_list(F.struct("n", "vec_id")))
    held = few.groupBy("key").agg(F.first("v").alias("v"), F.transform(in_turn, lambda x: x["vec_id"]).alias("ids"))
    held = staged(held.withColumn("dim", F.size("v")), "distinct-vectors")
    shards = held.groupBy("dim").count().select("dim", F.greatest(F.lit(least_shards), F.ceil(F.col("count") / shard_size)).cast("int").alias("shards"))
    asked = staged(rows.filter("is_query").select("vec_id", "key", "v").dropDuplicates(["vec_id", "key"]), "queries")
    shard = F.struct("dim", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int").alias("no"))
    dealt = held.join(F.broadcast(shards), "dim").select(shard.alias("shard"), "key", "ids", "v")

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        low = pdf["ids"].map(lambda ids: ids[0])
        pdf = pdf.iloc[np.lexsort([pdf["key"].to_numpy(str), low.fillna(0).to_numpy(), low.isna().to_numpy()])].reset_index(drop=True)
        edges, entry = build_graph(_augmented(np.stack(pdf["v"].to_numpy())), degree, beam, alpha)
        pdf["node"] = np.arange(len(pdf))
        pdf["edges"] = list(edges)
        pdf["entry"] = entry
        return pdf[["dim", "no", "node", "key", "ids", "v", "edges", "entry"]]

    kind = rows.schema["vec_id"].dataType.simpleString()
    graph = dealt.select("shard.dim", "shard.no", "key", "ids", "v").groupBy("dim", "no").applyInPandas(index, f"dim int, no int, node int, key string, ids array<{kind}>, v array<double>, edges array<int>, entry int")
    graph = staged(graph, "graph")
    asked_of = staged(asked.groupBy("key").agg(F.first("v").alias("v"), F.count("*").alias("n")), "query-vectors")
    wanted = asked_of.withColumn("dim", F.size("v")).join(F.broadcast(shards), "dim")
    wanted = wanted.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("no"), F.lit(None).cast("int").alias("node"), "key", F.lit(None).cast(f"array<{kind}>").alias("ids"), "v", F.lit(None).cast("array<int>").alias("edges"), F.lit(None).cast("int").alias("entry"))
    # in each task a shard's nodes come in order, and then the queries that it is asked
    in_order = graph.union(wanted).repartition("dim", "no").sortWithinPartitions("dim", "no", F.col("node").asc_nulls_last())

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, nodes, ready = None, [], None
        for batch in batches:
            dims, nos = (batch.column(c).to_numpy() for c in ("dim", "no"))
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(nos) != 0)) + 1
            for s, e in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
                if shard != (dims[s], nos[s]):
                    shard, nodes, ready = (dims[s], nos[s]), [], None
                part = batch.slice(s, e - s)
                is_node = part.column("node").is_valid()
                if (more := part.filter(is_node)).num_rows:
                    nodes.append(more)
                asks = part.filter(pc.invert(is_node))
                if not asks.num_rows or not nodes:
                    continue
                if ready is None:
                    ready = _Shard(pa.Table.from_batches(nodes))
                    nodes = [None]
                yield ready.answers(asks, max(beam, 2 * k), k + 1)

    found = in_order.mapInArrow(searched, f"query string, key string, ids array<{kind}>, score double")
    # of vectors at one score those with the smallest ids come first, so that no smaller id is cut
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("ids")[0].asc_nulls_last(), "key")
    pairs = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    many = F.broadcast(asked_of.filter(F.col("n") > heavy).select(F.col("key").alias("_k"), F.ceil(F.col("n") / heavy).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt_pairs = pairs.join(many, F.col("query") == F.col("_k"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("query", "part", "key", "score", F.posexplode("ids").alias("n", "vec_id"))
    ours = asked.join(many, F.col("key") == F.col("_k"), "left").select(F.col("vec_id").alias("query_id"), F.col("key").alias("query"), F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"))
    joined = ours.join(dealt_pairs, ["query", "part"])
    # the query's own row: one row of its vector and id
    mine = (F.col("key") == F.col("query")) & F.col("vec_id").eqNullSafe(F.col("query_id"))
    own = Window.partitionBy("query_id", "query", mine).orderBy("n")
    joined = joined.withColumn("copy", F.row_number().over(own)).filter(~mine | (F.col("copy") > 1))
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = joined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.col("query").alias("query_key"))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """Lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


class _Shard:
    """A shard's graph, held while its queries pass by."""

    def __init__(self, nodes: pa.Table):
        self.exact = _matrix(nodes.column("v"), np.float64)
        self.edges = _matrix(nodes.column("edges"), np.int32)
        self.points, self.entry = _augmented(self.exact), nodes.column("entry")[0].as_py()
        self.names = nodes.select(["key", "ids"]).combine_chunks()

    def answers(self, asks: pa.RecordBatch, beam: int, most: int) -> pa.RecordBatch:
        """Of each query the ``most`` best nodes by the exact product, of equal ones those with smaller ids."""
        names, wanted = asks.column("key").to_pylist(), _matrix(asks.column("v"), np.float64)
        scaled = np.hstack([wanted / np.sqrt((wanted**2).sum(axis=1))[:, None], np.zeros((len(wanted), 1))]).astype(np.float32)
        query, node, score = [], [], []
        size = max(16, 16_000_000 // len(self.points))
        for s in range(0, len(names), size):
            for i, row in enumerate(beam_search(self.points, self.edges, self.entry, scaled[s : s + size], beam), s):
                row = np.sort(row[row >= 0])  # nodes are in order of their smallest ids
                value = (self.exact[row] * wanted[i]).sum(axis=1)
                best = np.argsort(-value, kind="stable")[:most]
                query += [names[i]] * len(best)
                node += row[best].tolist()
                score += value[best].tolist()
        found = self.names.take(pa.array(node, pa.int64())).combine_chunks()
        columns = [found.column(c).chunk(0) if found.num_rows else pa.array([], found.schema.field(c).type) for c in ("key", "ids")]
        return pa.RecordBatch.from_arrays([pa.array(query, pa.string()), *columns, pa.array(score, pa.float64())], ["query", "key", "ids", "score"])


def brute_force(ids: list[int], vectors: np.ndarray, query: int, k: int = 20) -> list[tuple[int, float]]:
    """The true nearest of one query, for measuring recall."""
    score = (vectors * vectors[query]).sum(axis=1)
    order = sorted((i for i in range(len(ids)) if ids[i] != ids[query]), key=lambda i: (-score[i], ids[i]))
    return [(ids[i], float(score[i])) for i in order[:k]]
