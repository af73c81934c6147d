"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

Rows with one vector are a class and stand in the graph once. The graph starts from the nearest within blocks that
random hyperplanes cut (several cuts, no block over ``LEAF`` vectors), then each round joins neighbours of neighbours: a
vector's list of its neighbours and of those it is a neighbour of (``FRESH`` newly found and ``OLD`` others at most) is
compared pair by pair, and what beats the farthest neighbour of either goes into that one's ``K``. A query starts at
its own place in the graph; each step opens the nearest ``OPEN`` places of its ``BEAM`` that are still closed. Graph and search
work on unit vectors in single precision; the scores of what stands in the beam at the end are cosines in double precision
of the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, parts_for, table, written

K = 48
LEAF, TREES = 1024, 6
ROUNDS, FRESH, OLD = 4, 32, 24
STEPS, BEAM, OPEN = 3, 48, 12
TOP = 5
EVERY = 50
SEED = 64


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>), norm of the distinct rows that take part.

    Null ids, null or zero vectors, and vectors with null or non-finite components take no part, nor do those of another
    length than most have.
    """
    rows = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).where("vec_id is not null")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.where(F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True))).withColumn("norm", norm).where("norm > 0")
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0].d if sizes else 0)).distinct()


def _groups(batches: Iterator[pa.RecordBatch], names: int) -> Iterator[tuple]:
    """Runs of rows with equal first ``names`` columns, as lists of the others' columns; the rows come sorted."""
    held, name = [], None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(names)]
        if not batch.num_rows:
            continue
        new = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
        for a, b in zip(new, np.append(new[1:], batch.num_rows)):
            key = tuple(c[a] for c in cols)
            if key != name and held:
                yield name, pa.Table.from_batches(held)
                held = []
            name = key
            held.append(batch.slice(a, b - a))
    if held:
        yield name, pa.Table.from_batches(held)


def _matrix(column) -> np.ndarray:
    """Unit vectors, kept as single-precision bytes."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def packed(nodes: DataFrame) -> DataFrame:
    """id, vec: unit vectors as single-precision bytes. ``nodes``: id, embedding, norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1) / batch.column("norm").to_numpy()[:, None] if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())], ["id", "vec"])

    return nodes.select("id", "embedding", "norm").mapInArrow(run, "id long, vec binary")


def first_graph(nodes: DataFrame, n: int) -> DataFrame:
    """id, nbr, sim: the nearest within blocks. ``nodes``: id, vec."""
    bits = max(0, math.ceil(math.log2(max(1, n) / LEAF))) if n > LEAF else 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"))
            for tree in range(TREES):
                planes = np.random.default_rng([SEED, tree]).standard_normal((x.shape[1], bits)).astype(np.float32)
                code = ((x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree), pa.int32()), pa.array(code, pa.int64()), batch.column("id"), batch.column("vec")], ["tree", "code", "id", "vec"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _groups(batches, 3):
            ids, x = block.column("id").to_numpy(), _matrix(block.column("vec"))
            if len(ids) < 2:
                continue
            for at in range(0, len(ids), 512):
                sim = x[at : at + 512] @ x.T
                own = np.arange(len(sim))
                sim[own, own + at] = -9
                k = min(K, len(ids) - 1)
                best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + 512], k)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(sim, best, 1).ravel(), pa.float32())], ["id", "nbr", "sim"])

    cuts = written(nodes.mapInArrow(cut, "tree int, code long, id long, vec binary"), "ann-cuts")
    sizes = cuts.groupBy("tree", "code").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", "tree"), F.col("parts")).cast("int")
    dealt = cuts.join(sizes, ["tree", "code"]).select("tree", "code", part.alias("part"), "id", "vec")
    dealt = dealt.repartition(parts_for(nodes.sparkSession), "tree", "code", "part").sortWithinPartitions("tree", "code", "part")
    graph = best_of(dealt.mapInArrow(near, "id long, nbr long, sim float").withColumn("born", F.lit(0)))
    drop(cuts)
    return graph


def best_of(edges: DataFrame) -> DataFrame:
    """The ``K`` nearest distinct neighbours of each id."""
    edges = edges.repartition(parts_for(edges.sparkSession), "id")  # serves both the distinct pairs and the ranks
    edges = edges.groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.min("born").alias("born"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "nbr"))
    return written(edges.withColumn("rank", rank).where(F.col("rank") <= K).drop("rank"), "ann-graph")


def joined(graph: DataFrame, nodes: DataFrame, step: int) -> DataFrame:
    """id, nbr, sim of pairs that have a neighbour in common and beat what one of them has."""
    fresh = (F.col("born") == step - 1).alias("fresh")
    both = graph.select(F.col("id").alias("at"), F.col("nbr").alias("id"), fresh).unionByName(graph.select(F.col("nbr").alias("at"), "id", fresh))
    both = both.groupBy("at", "id").agg(F.max("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("at", "fresh").orderBy(F.xxhash64("at", "id", F.lit(step)), "id"))
    both = both.withColumn("rank", rank).where(F.col("rank") <= FRESH).where(F.col("fresh") | (F.col("rank") <= OLD)).drop("rank")
    bars = graph.groupBy("id").agg(F.when(F.count("*") >= K, F.min("sim")).otherwise(-2.0).cast("float").alias("bar"))
    known = nodes.join(bars, "id", "left").select("id", "vec", F.coalesce("bar", F.lit(-2.0)).cast("float").alias("bar"))
    lists = both.join(known, "id").select("at", "id", "fresh", "bar", "vec")
    lists = lists.repartition(parts_for(nodes.sparkSession), "at").sortWithinPartitions("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for _, block in _groups(batches, 1):
            ids, x = block.column("id").to_numpy(), _matrix(block.column("vec"))
            fresh, bar = block.column("fresh").to_numpy(), block.column("bar").to_numpy()
            sim = x @ x.T
            wanted = (sim > bar[:, None]) & (fresh[:, None] | fresh[None, :])
            np.fill_diagonal(wanted, False)
            a, b = np.nonzero(wanted)
            out.append((ids[a], ids[b], sim[a, b]))
            size += len(a)
            if size > 200_000:
                yield distinct(out)
                out, size = [], 0
        if out:
            yield distinct(out)

    def distinct(out: list) -> pa.RecordBatch:
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((b, a))
        first = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]) if len(order) else np.zeros(0, bool)
        keep = order[first]
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(s[keep], pa.float32())], ["id", "nbr", "sim"])

    return lists.mapInArrow(run, "id long, nbr long, sim float").withColumn("born", F.lit(step))


def neighbour_graph(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    graph = first_graph(nodes, nodes.count())
    for step in range(1, rounds + 1):
        before, graph = graph, best_of(graph.unionByName(joined(graph, nodes, step)))
        drop(before)
    return graph


def searched(asks: DataFrame, graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """q, id, sim: what is in the beam of the greedy search from each ``asks`` (q). ``nodes``: id, vec."""
    back = graph.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "sim")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "nbr"))
    back = back.withColumn("rank", rank).where(F.col("rank") <= K).drop("rank")
    ways = written(graph.select("id", "nbr").unionByName(back.select("id", "nbr")).distinct(), "ann-ways")
    own = written(asks.join(nodes, asks.q == nodes.id).select("q", F.col("vec").alias("ask")), "ann-asks")

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sim = np.einsum("ij,ij->i", _matrix(batch.column("ask")), _matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("id"), pa.array(sim, pa.float32())], ["q", "id", "sim"])

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(nodes, "id").join(own, "q").select("q", "id", "ask", "vec").mapInArrow(dots, "q long, id long, sim float")

    met = written(scored(asks.select("q", F.col("q").alias("id"))).withColumn("opened", F.lit(False)), "ann-met")
    by = Window.partitionBy("q")
    for _ in range(STEPS):
        near = met.withColumn("rank", F.row_number().over(by.orderBy(F.desc("sim"), "id"))).where(F.col("rank") <= BEAM).where("not opened")
        opened = near.withColumn("turn", F.row_number().over(by.orderBy("rank"))).where(F.col("turn") <= OPEN).select("q", "id")
        opened = written(opened, "ann-opened")
        found = opened.join(ways, "id").select("q", F.col("nbr").alias("id")).distinct().join(met.select("q", "id"), ["q", "id"], "left_anti")
        marked = met.join(opened.withColumn("now", F.lit(True)), ["q", "id"], "left").select("q", "id", "sim", (F.col("opened") | F.coalesce("now", F.lit(False))).alias("opened"))
        before, met = met, written(marked.unionByName(scored(found).withColumn("opened", F.lit(False))), "ann-met")
        drop(before, opened)
    drop(ways, own)
    return met.withColumn("rank", F.row_number().over(by.orderBy(F.desc("sim"), "id"))).where(F.col("rank") <= BEAM).select("q", "id")


def nearest(rows: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row whose vec_id ``every`` divides.

    Repeated rows count once, and no row answers a query of its own id; ties go to the smaller vec_id; fewer candidates give
    fewer ranks; other columns are ignored, whatever their names; no rows give no rows. See ``usable`` for rows that take no part.
    """
    rows = written(usable(rows), "ann-rows")
    nodes = written(rows.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.first("norm").alias("norm")), "ann-nodes")
    unit = written(packed(nodes), "ann-unit")
    members = written(rows.join(nodes.select("id", "embedding"), "embedding").select("vec_id", "id"), "ann-members")
    graph = neighbour_graph(unit)
    queries = members.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"))
    met = searched(queries.select("q").distinct(), graph, unit)
    drop(rows, graph, unit)
    asks = nodes.select(F.col("id").alias("q"), F.col("embedding").alias("ask"), F.col("norm").alias("ask_norm"))
    dot = F.aggregate(F.zip_with("ask", "embedding", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    met = met.join(nodes, "id").join(asks, "q").select("q", "id", (dot / (F.col("ask_norm") * F.col("norm"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    met = met.withColumn("rank", rank).where(F.col("rank") <= top + 1).drop("rank")
    some = members.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("rank") <= top + 1).drop("rank")
    found = met.join(some, "id").join(queries, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
