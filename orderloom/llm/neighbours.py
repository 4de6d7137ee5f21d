"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries search it greedily.

Equal vectors are one node of the graph, with the smallest ids that have it, as many as an answer can use.
The graph starts from several random orderings (signs of random projections), cut into runs of bounded
size whose members are compared with each other. Then neighbours of neighbours, forwards and backwards,
are compared by joins, round by round, and each node keeps its best, until hardly any list changes. While the graph is built and searched,
vectors travel as the bytes of their floats, and products are double; the scores of the answers are exact.

A query is itself a node. Its search starts at its neighbours and expands the best unexpanded nodes round
by round, by a join with the graph, until every node of its beam is expanded.

Results for odd input: vectors that are NULL, zero, hold NULL or non-finite components, or have another
dimension than most, take no part, as queries or candidates, nor do NULL ids. Rows repeating an id count
once (with the smallest vector). Ties go to smaller ids. With few vectors every query gets all candidates. An
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import staged


@dataclass(frozen=True)
class Settings:
    degree: int = 48  # neighbours that a node keeps
    orderings: int = 10  # random orderings the graph starts from
    run: int = 2048  # nodes compared with each other at the start
    settled: float = 0.001  # share of fresh entries at which NN-descent ends
    sample: int = 24  # neighbours of each direction that take part in a round of NN-descent
    beam: int = 96  # nodes that a search keeps
    expand: int = 32  # of them expanded in a round


LISTS = "v long, near array<bigint>, sim array<double>, fresh array<boolean>"


def valid(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, x): rows that take part, one per id."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(id).isNotNull() & x.isNotNull()).where(finite & F.exists(x, lambda c: c != 0))
    rows = rows.groupBy(F.col(id).cast("long").alias("id")).agg(F.min(x).alias("x"))
    common = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("x") == (common["n"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles from bytes whose first one says how many bytes a component has."""
    raws = column.to_pylist()
    kind = np.dtype(f"<f{raws[0][0]}") if raws else np.dtype("<f4")
    return np.frombuffer(b"".join([r[1:] for r in raws]), kind).astype(np.float64).reshape(len(raws), -1)


def _bytes(nodes: DataFrame) -> DataFrame:
    """(v, code): components as they are, 4 bytes each if the column holds floats and 8 otherwise."""
    size = 4 if nodes.schema["x"].dataType.elementType.typeName() == "float" else 8

    def work(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), f"<f{size}").reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([bytes([size]) + c.tobytes() for c in x], pa.binary())], ["v", "code"])

    return nodes.select("v", "x").mapInArrow(work, "v long, code binary")


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest entries of each row."""
    k = min(k, sims.shape[1])
    return np.argpartition(-sims, k - 1, axis=1)[:, :k]


def _rows(v, near, sim, fresh) -> pa.RecordBatch:
    """Lists of equal length, from two-dimensional arrays."""
    ends = pa.array(np.arange(0, near.size + 1, max(1, near.shape[1])), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(a.ravel(), t)) for a, t in ((near, pa.int64()), (sim, pa.float64()), (fresh, pa.bool_()))]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), *lists], ["v", "near", "sim", "fresh"])


def _start(codes: DataFrame, n: int, settings: Settings) -> DataFrame:
    """Lists from runs of random orderings."""
    signs = max(0, int(np.ceil(np.log2(max(1, n / settings.run)))) + 2)

    def orderings(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            for t in range(settings.orderings):
                planes = np.random.default_rng(t).standard_normal((x.shape[1], signs + 1))
                at = x @ planes
                code = (at[:, :signs] > 0) @ (1 << np.arange(signs)[::-1]) if signs else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t), pa.int32()), pa.array(code, pa.int64()), pa.array(at[:, -1]), *batch.columns],
                    ["t", "code", "at", "v", "bytes"])

    def compare(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []

        def run(rows: pa.Table):
            v = rows["v"].to_numpy()
            x = _matrix(rows["bytes"])
            for at in range(0, len(v), 512):
                sims = x[at:at + 512] @ x.T
                sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -np.inf
                best = _top(sims, min(settings.degree, len(v) - 1))
                yield _rows(v[at:at + 512], v[best], np.take_along_axis(sims, best, 1), np.ones(best.shape, bool))

        def runs(rows: pa.Table):
            for t in np.unique(rows["t"].to_numpy()).tolist():
                own = rows.filter(pa.array(rows["t"].to_numpy() == t))
                for at in range(0, len(own), settings.run):
                    part = own.slice(at, settings.run)
                    if len(part) > 1:
                        yield from run(part)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * settings.run:
                yield from runs(pa.Table.from_batches(held))
                held = []
        if held:
            yield from runs(pa.Table.from_batches(held))

    parts = max(1, -(-n * settings.orderings // settings.run))
    rows = codes.mapInArrow(orderings, "t int, code long, at double, v long, bytes binary")
    rows = rows.repartitionByRange(parts, "t", "code", "at").sortWithinPartitions("t", "code", "at")
    return rows.mapInArrow(compare, LISTS)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One list per node: its k best entries, best first; an entry that was there before is not fresh."""

    def best(rows: pa.Table):
        sizes = np.diff(rows["near"].combine_chunks().offsets.to_numpy())
        v = np.repeat(rows["v"].to_numpy(), sizes)
        near, sim, fresh = (rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("near", "sim", "fresh"))
        order = np.lexsort((fresh, near, v))
        v, near, sim, fresh = v[order], near[order], sim[order], fresh[order]
        one = np.concatenate(([True], (v[1:] != v[:-1]) | (near[1:] != near[:-1]))) if len(v) else np.zeros(0, bool)
        v, near, sim, fresh = v[one], near[one], sim[one], fresh[one]
        order = np.lexsort((near, -sim, v))
        v, near, sim, fresh = v[order], near[order], sim[order], fresh[order]
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(v)))
        keep = np.arange(len(v)) - np.repeat(first, counts) < k
        ends = pa.array(np.concatenate(([0], np.cumsum(np.minimum(counts, k)))), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(v[first]), *(pa.ListArray.from_arrays(ends, pa.array(a[keep], t)) for a, t in ((near, pa.int64()), (sim, pa.float64()), (fresh, pa.bool_())))],
            ["v", "near", "sim", "fresh"])

    return _by_key(lists, "v", best, LISTS)


def _by_key(rows: DataFrame, key: str, work, schema: str) -> DataFrame:
    """``work`` over tables that hold whole groups of ``key``, a bounded number of rows at a time."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 20_000:
                continue
            table = pa.Table.from_batches(held)
            keys = table[key].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from work(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition(n, key).sortWithinPartitions(key).mapInArrow(run, schema)


def _few(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows per key, fresh ones first; Spark limits groups before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("fresh"), F.desc("sim"), "member"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def _aged(graph: DataFrame, sample: int) -> DataFrame:
    """The lists after a round: fresh entries that it did not sample wait, still fresh, for the next one."""

    def work(batches):
        for batch in batches:
            lists = batch.column(3)
            fresh = lists.flatten().to_numpy(zero_copy_only=False).astype(bool)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            count = np.concatenate(([0], np.cumsum(fresh)))
            place = count[1:] - np.repeat(count[ends[:-1]], np.diff(ends))
            waits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(fresh & (place > sample)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], waits], ["v", "near", "sim", "fresh"])

    return graph.select("v", "near", "sim", "fresh").mapInArrow(work, LISTS)


def _descend(graph: DataFrame, codes: DataFrame, settings: Settings) -> DataFrame:
    """Lists of what comparing neighbours of neighbours finds, better than what their nodes have."""
    edges = graph.select(F.col("v").alias("center"), F.explode(F.arrays_zip("near", "sim", "fresh")).alias("e"))
    edges = edges.select("center", F.col("e.near").alias("member"), F.col("e.sim").alias("sim"), F.col("e.fresh").alias("fresh"))
    forward = _few(edges, "center", settings.sample)
    backward = edges.select(F.col("member").alias("center"), F.col("center").alias("member"), "sim", "fresh")
    backward = _few(backward, "center", settings.sample)
    least = graph.select(F.col("v").alias("member"), F.when(F.size("sim") >= settings.degree, F.element_at("sim", -1)).otherwise(float("-inf")).alias("least"))
    known = codes.withColumnRenamed("v", "member").join(least, "member")
    pairs = forward.union(backward).groupBy("center", "member").agg(F.max("fresh").alias("fresh"))
    rows = pairs.join(known, "member").select("center", "member", "fresh", "code", "least")

    def compare(table: pa.Table):
        center = table["center"].to_numpy()
        member, fresh = table["member"].to_numpy(), table["fresh"].to_numpy(zero_copy_only=False)
        least = table["least"].to_numpy()
        x = _matrix(table["code"])
        starts = np.flatnonzero(np.concatenate(([True], center[1:] != center[:-1])))
        out: list[tuple] = []
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(center)).tolist()):
            new = fresh[a:b]
            if b - a < 2 or not new.any():
                continue
            sims = x[a:b] @ x[a:b].T
            better = (sims > least[a:b, None]) & (new[:, None] | new[None, :])
            np.fill_diagonal(better, False)
            i, j = np.nonzero(better)
            if len(i):
                out.append((member[a + i], member[a + j], sims[i, j]))
        if out:
            v, near, sim = (np.concatenate([o[k] for o in out]) for k in range(3))
            order = np.lexsort((near, v))
            v, near, sim = v[order], near[order], sim[order]
            one = np.concatenate(([True], (v[1:] != v[:-1]) | (near[1:] != near[:-1])))
            v, near, sim = v[one], near[one], sim[one]
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            ends = pa.array(np.append(first, len(v)), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(c, t)) for c, t in ((near, pa.int64()), (sim, pa.float64()), (np.ones(len(v), bool), pa.bool_())))
            yield pa.RecordBatch.from_arrays([pa.array(v[first]), *lists], ["v", "near", "sim", "fresh"])

    return _by_key(rows, "center", compare, LISTS)


def build(codes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The neighbour graph of (v, code): v, near, sim, fresh."""
    n = codes.count()
    graph = staged(_merged(_start(codes, n, settings), settings.degree), "neighbours-graph")
    while True:
        old = _aged(graph, settings.sample)
        graph = staged(_merged(old.unionByName(_descend(graph, codes, settings)), settings.degree), "neighbours-graph")
        news = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f)))).first()[0] or 0
        if news <= settings.settled * n * settings.degree:
            return graph


def search(queries: DataFrame, graph: DataFrame, codes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(q, w, sim): the beam of each node of ``queries`` (q) after its search."""
    graph = graph.select("v", "near", "sim")
    entries = F.explode(F.arrays_zip("near", "sim")).alias("e")
    beam = queries.join(graph, queries.q == graph.v).select("q", entries)
    beam = staged(beam.select("q", F.col("e.near").alias("w"), F.col("e.sim").alias("sim"), F.lit(False).alias("done")), "neighbours-beam")
    schema = "q long, w long, sim double, done boolean"
    while True:
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("done"), F.desc("sim"), "w"))
        ranked = beam.withColumn("now", (rank <= settings.expand) & ~F.col("done"))
        ranked = staged(ranked, "neighbours-now")
        nows = ranked.where("now").select("q", "w")
        found = nows.join(graph, nows.w == graph.v).select("q", F.explode("near").alias("w")).where("q <> w").distinct()
        found = found.join(codes.withColumnRenamed("v", "w"), "w").select("q", "w", "code", F.lit(None).cast("double").alias("sim"), F.lit(False).alias("done"))
        own = queries.join(codes, queries.q == codes.v).select("q", "q", "code", F.lit(None).cast("double"), F.lit(True))
        had = ranked.select("q", "w", F.lit(None).cast("binary").alias("code"), "sim", (F.col("done") | F.col("now")).alias("done"))

        def scored(table: pa.Table):
            q, w = table["q"].to_numpy(), table["w"].to_numpy()
            sim = table["sim"].to_numpy(zero_copy_only=False).astype(np.float64)
            done = table["done"].to_numpy(zero_copy_only=False).astype(bool)
            code = table["code"].combine_chunks()
            has = np.flatnonzero(~np.asarray(code.is_null()))
            x = np.zeros((len(q), 0))
            if len(has):
                part = _matrix(code.take(pa.array(has)))
                x = np.zeros((len(q), part.shape[1]))
                x[has] = part
            starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            outs = []
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(q)).tolist()):
                me = a + np.flatnonzero(w[a:b] == q[a])
                if not len(me):
                    continue
                s = sim[a:b].copy()
                new = np.isnan(s)
                s[new] = x[a:b][new] @ x[me[0]]
                order = np.lexsort((~done[a:b], w[a:b]))  # known entries before new ones
                order = order[w[a:b][order] != q[a]]
                one = np.concatenate(([True], w[a:b][order][1:] != w[a:b][order][:-1])) if len(order) else np.zeros(0, bool)
                order = order[one]
                best = order[np.lexsort((w[a:b][order], -s[order]))][:settings.beam]
                outs.append((q[a:b][best], w[a:b][best], s[best], done[a:b][best]))
            if outs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in outs])) for i in range(4)], ["q", "w", "sim", "done"])

        beam = staged(_by_key(had.union(found.select("q", "w", "code", "sim", "done")).union(own), "q", scored, schema), "neighbours-beam")
        if beam.where("NOT done").limit(1).count() == 0:
            return beam.select("q", "w", "sim")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding",
            settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``is_query`` (over ``id``) marks."""
    rows = staged(valid(vectors, id, vector), "neighbours-rows")
    rank = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    members = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    nodes = staged(
        members.groupBy("x").agg(F.min("id").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")), "neighbours-nodes")
    codes = staged(_bytes(nodes), "neighbours-codes")
    graph = build(codes, settings)
    asked = rows.where(is_query).join(nodes.select("x", "v"), "x").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    asked = staged(asked, "neighbours-queries")
    queries = asked.select("q").distinct()
    beam = search(queries, graph, codes, settings)
    few = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "w"))
    near = beam.withColumn("r", few).where(F.col("r") <= 2 * k + 10).select("q", "w").union(queries.select("q", F.col("q").alias("w")))
    mine, other = nodes.select(F.col("v").alias("q"), F.col("x").alias("a")), nodes.select(F.col("v").alias("w"), F.col("x").alias("b"), "ids")
    products = F.aggregate(
        F.zip_with("a", "b", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, p: s + p)
    scored = near.join(mine, "q").join(other, "w").select("q", "ids", products.alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    answers = asked.join(scored, "q").select("query_id", F.explode("ids").alias("vec_id"), "score")
    answers = answers.where("query_id <> vec_id").withColumn("rank", best).where(F.col("rank") <= k)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
