"""Approximate nearest neighbours: NN-descent builds the graph, greedy search answers.

The graph is over distinct vectors, so thousands of copies of one vector are a
single node.  It starts from neighbours in cells of random hyperplanes; then, in
joins of neighbours with neighbours of neighbours, every node introduces those
around it to each other, and each node keeps its nearest, until few change.

Vectors travel as one byte a component around their mean, with a factor for each
vector; such distances only guide the way, and the answers are measured exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.stash import stash

#: Neighbours of a node, the share of changed edges to stop at, and rounds after which it counts as failed.
K, SETTLED, ROUNDS = 20, 0.02, 60
#: Sets of hyperplanes to start from, hyperplanes in a set, nodes compared with each other, neighbours that each takes from them.
TREES, PLANES, CHUNK, TAKEN = 12, 24, 512, 8
#: Greedy search: nodes remembered and nodes opened a round for each query, entry points besides a query's own node, rounds after which it counts as failed.
BEAM, OPENED, ENTRIES, SEARCH_ROUNDS = 384, 64, 16, 500
#: Of the remembered nodes so many are measured exactly, at least.
EXACT = 48
#: A node with more neighbours than this pointing to it introduces them in parts.
PART = 128


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, v)``: vectors that take part: not null or zero, all components finite.  Of one id's vectors the smallest counts."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(v.isNotNull() & F.col(key).isNotNull()).where(fine)
    return rows.groupBy(F.col(key).alias("id")).agg(F.min(v).alias("v"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    square = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def _floats(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed vectors: four bytes for the factor, one for each component."""
    raw = np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint8)
    raw = raw.reshape(len(column), -1) if len(column) else raw.reshape(0, 5)
    factor = np.ascontiguousarray(raw[:, :4]).view("<f4")
    return raw[:, 4:].view(np.int8).astype(np.float32) * factor


def packed(nodes: DataFrame) -> DataFrame:
    """``(node, z, cells)`` of ``nodes(node, v)``: the packed vector, and for each set of hyperplanes the sides it lies on."""
    mean = nodes.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()  # one row a component
    centre = np.array([r["m"] for r in mean], np.float32)
    planes = np.random.default_rng(len(centre)).normal(size=(len(centre), TREES * PLANES)).astype(np.float32)
    powers = 1 << np.arange(PLANES - 1, -1, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _floats(batch.column("v")) - centre
            factor = np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(np.float32).tiny) / 127
            raw = np.concatenate([factor.astype("<f4").view(np.uint8), np.round(x / factor).astype(np.int8).view(np.uint8)], axis=1)
            sides = ((x @ planes) > 0).reshape(len(x), TREES, PLANES) @ powers
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * TREES + 1, TREES), pa.int32()), pa.array(sides.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in raw], pa.binary()), cells], ["node", "z", "cells"])

    return nodes.select("node", "v").mapInArrow(run, "node long, z binary, cells array<long>")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between rows, up to rounding: for ranking only."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.maximum(d, 0)


def _edges(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float32())], ["u", "v", "d"])


def _start(nodes: DataFrame) -> DataFrame:
    """First neighbours: for each set of hyperplanes nodes are ordered by the sides they lie on (a range shuffle), so runs
    share most of them, and in each run of ``CHUNK`` rows each takes its nearest."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, ids, x = batch.column("tree").to_numpy(), batch.column("node").to_numpy(), _matrix(batch.column("z"))
            cut = [0, *(np.flatnonzero(np.diff(tree)) + 1).tolist(), len(ids)]
            for begin, end in zip(cut[:-1], cut[1:], strict=True):
                for lo in range(begin, end, CHUNK):
                    lo = max(begin, min(lo, end - CHUNK))
                    own, y = ids[lo : min(lo + CHUNK, end)], x[lo : min(lo + CHUNK, end)]
                    d = _squares(y, y)
                    np.fill_diagonal(d, np.inf)
                    n = min(TAKEN, len(own) - 1)
                    if n > 0:
                        best = np.argpartition(d, n - 1, axis=1)[:, :n]
                        yield _edges(np.repeat(own, n), own[best].ravel(), np.take_along_axis(d, best, 1).ravel())

    line = nodes.select("node", "z", F.posexplode("cells").alias("tree", "cell"))
    line = line.repartitionByRange("tree", "cell", "node").sortWithinPartitions("tree", "cell", "node").select("tree", "node", "z")
    return line.mapInArrow(near, "u long, v long, d float")


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node; ``fresh`` stays true only for edges that are new.  One shuffle serves both steps."""
    edges = edges.repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return edges.withColumn("_k", place).where(F.col("_k") <= k).drop("_k")


def _keyed(work: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable:
    """For ``mapInArrow`` on rows sorted by ``key``: ``work`` on the rows of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            key = table.column("key").to_numpy()
            cut = np.flatnonzero(np.diff(key)) + 1
            edges = [0, *cut.tolist()]
            for a, b in zip(edges, edges[1:], strict=False):
                if (out := work(table.slice(a, b - a))) is not None:
                    yield out
            held = table.slice(edges[-1])
        if held is not None and held.num_rows and (out := work(held)) is not None:
            yield out

    return run


def _introduce(table: pa.Table) -> pa.RecordBatch | None:
    """Around one node: pairs of which one is nearer to the other than its last neighbour."""
    batch = table.combine_chunks().to_batches()[0]
    ids, x = batch.column("w").to_numpy(), _matrix(batch.column("z"))
    last, fresh = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("last", "fresh"))
    if not fresh.any():
        return None
    d = _squares(x, x)
    a, b = np.nonzero((fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :]) & (d < last[:, None]))
    if not len(a):
        return None
    # a node that points to this one and is pointed to stands here twice
    u, v, d = ids[a], ids[b], d[a, b]
    order = np.lexsort((v, u))
    u, v, d = u[order], v[order], d[order]
    new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
    return _edges(u[new], v[new], d[new])


def build_graph(nodes: DataFrame, k: int = K) -> DataFrame:
    """NN-descent over ``nodes(node, z, cells)`` (stashed, distinct): edges ``(u, v, d)``, at most k from each node.

    A round sends both ends of every edge to the other end, where all who arrive
    meet; pairs of two edges that were both there before are left out.  A node
    that very many point to does this in parts of ``PART``, each with the nodes
    it points to itself, so the work is linear in the number of edges whatever
    their ends.  Rounds go on until at most ``SETTLED`` of the edges change.
    """
    edges = stash(_nearest(_start(nodes).withColumn("fresh", F.lit(True)), k), "knn")
    total = nodes.count() * k
    for _ in range(ROUNDS):
        last = edges.groupBy("u").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).cast("float").alias("last"))
        known = nodes.join(last, nodes["node"] == last["u"]).select(F.col("node").alias("w"), "z", "last")
        parts = edges.groupBy(F.col("v").alias("m")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        many = parts.where("parts > 1")
        ends = edges.select(F.col("u").alias("m"), F.col("v").alias("w"), "fresh")
        ends = ends.join(many, "m", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        back = edges.select(F.col("v").alias("m"), F.col("u").alias("w"), "fresh")
        back = back.join(many, "m", "left").withColumn("part", F.pmod(F.xxhash64("w"), F.coalesce("parts", F.lit(1))).cast("int"))
        both = ends.unionByName(back).join(known, "w")
        both = both.select(F.xxhash64("m", "part").alias("key"), "w", "z", "last", "fresh")
        met = both.repartition("key").sortWithinPartitions("key").mapInArrow(_keyed(_introduce), "u long, v long, d float")
        # an edge that was there before is not fresh in the next round
        edges = stash(_nearest(edges.withColumn("fresh", F.lit(False)).unionByName(met.withColumn("fresh", F.lit(True))), k), "knn", instead_of=edges)
        if edges.where("fresh").count() <= SETTLED * total:
            break
    else:
        raise RuntimeError(f"the neighbour graph did not settle in {ROUNDS} rounds")
    return edges.select("u", "v", "d")


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of packed vectors ``z`` and ``q`` of each row."""
    for batch in batches:
        d = ((_matrix(batch.column("z")) - _matrix(batch.column("q"))) ** 2).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), pa.array(d, pa.float32())], ["query_id", "node", "d"])


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Greedy search from ``queries(query_id, q)``: ``(query_id, node, d)``, the ``BEAM`` nearest nodes met.

    ``nodes(node, z)`` and ``q`` are packed (see :func:`packed`); ``d`` is squared
    and as exact as they are.  A query starts at ``ENTRIES`` fixed nodes, and at
    its own where ``own(query_id, node)`` names one; each round opens its nearest
    unopened nodes, all queries at once in one join with the edges (taken both
    ways), until no query has an unopened node among its ``BEAM`` nearest.
    """
    ways = graph.select("u", "v").unionAll(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    ways = stash(ways, "ways")
    entries = nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES)
    start = queries.select("query_id").crossJoin(F.broadcast(entries))  # a fixed number of rows
    if own is not None:
        start = start.unionByName(own.select("query_id", "node"))
    vectors = nodes.select("node", "z")

    def measured(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct().join(vectors, "node").join(queries, "query_id")
        return pairs.select("query_id", "node", "z", "q").mapInArrow(_apart, "query_id long, node long, d float")

    nearest = Window.partitionBy("query_id").orderBy("d", "node")

    def kept(state: DataFrame) -> DataFrame:
        state = state.groupBy("query_id", "node").agg(F.min("d").alias("d"), F.max("open").alias("open"))
        return state.withColumn("_k", F.row_number().over(nearest)).where(F.col("_k") <= BEAM).drop("_k")

    state = stash(kept(measured(start).withColumn("open", F.lit(False))), "beam")
    for _ in range(SEARCH_ROUNDS):
        turn = state.where("not open").withColumn("_k", F.row_number().over(nearest)).where(F.col("_k") <= OPENED).select("query_id", "node")
        found = turn.join(ways, turn["node"] == ways["u"]).select("query_id", F.col("v").alias("node"))
        found = found.join(state.select("query_id", "node"), ["query_id", "node"], "left_anti")
        opened = state.join(turn.withColumn("_now", F.lit(True)), ["query_id", "node"], "left")
        opened = opened.select("query_id", "node", "d", (F.col("open") | F.coalesce("_now", F.lit(False))).alias("open"))
        state = stash(kept(opened.unionByName(measured(found).withColumn("open", F.lit(False)))), "beam", instead_of=state)
        if not state.where("not open").take(1):
            break
    else:
        raise RuntimeError(f"the search still had unopened nodes after {SEARCH_ROUNDS} rounds")
    return state.select("query_id", "node", "d")


def _of_one_length(rows: DataFrame, asked: DataFrame, k: int, key: str) -> DataFrame:
    """The answers among ``rows(id, v)`` (stashed, vectors of one length)."""
    w = Window.partitionBy("v").orderBy("id")
    members = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k + 1)
    members = stash(members.groupBy("v").agg(F.min("id").alias("node"), F.collect_list("id").alias("ids")), "members")
    nodes = stash(packed(members.select("node", "v")), "nodes")
    graph = build_graph(nodes)
    queries = rows.join(asked, rows["id"] == asked["query_id"]).select("query_id", F.col("v").alias("q"))
    queries = stash(queries.join(members, F.col("q") == F.col("v")).select("query_id", "q", "node"), "queries")
    own = queries.select("query_id", "node")
    found = search(nodes, graph, own.join(nodes, "node").select("query_id", F.col("z").alias("q")), own)
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "node"))
    found = found.withColumn("_k", first).where(F.col("_k") <= max(EXACT, 2 * k)).select("query_id", "node")
    found = found.join(members, "node").join(queries.select("query_id", "q"), "query_id")
    found = found.select("query_id", distance(F.col("q"), F.col("v")).alias("score"), F.explode("ids").alias(key)).where(F.col(key) != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, <key>, score)``: the k nearest rows found for each row with ``is_query``, itself left out.

    Ties go to the smaller id.  Vectors that are null, zero, or hold a null or
    non-finite component take no part; vectors of different lengths have no
    distance, so each length is a search of its own.  An empty table gives an
    empty result.  Of rows with equal vectors only the k + 1 smallest ids can be
    among the nearest, so no more are kept (the others could only follow them);
    of an id that stands several times the smallest vector counts.
    """
    rows = stash(usable(vectors, key, vector), "vectors")
    lengths = [r["n"] for r in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]  # one row a length
    asked = vectors.where(is_query).select(F.col(key).alias("query_id")).where("query_id is not null").distinct()
    parts = [_of_one_length(rows.where(F.size("v") == n), asked, k, key) for n in lengths]
    return reduce(DataFrame.unionAll, parts) if parts else rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(key), F.lit(0.0).alias("score"))


def op4_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(rows, F.col("vec_id") % 100 == 0)
