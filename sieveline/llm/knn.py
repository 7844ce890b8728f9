"""Approximate nearest neighbours by NN-descent and greedy graph search.

The index is a graph of each distinct vector's nearest neighbours. It starts from small random-hyperplane
buckets and improves by rounds: neighbours of a common vector meet in its group (Spark joins and one shuffle),
and pairs that beat a vector's worst neighbour enter its list. A query walks the graph from its own place in it,
opening the best candidates until none of the best is unopened. All queries walk in step, one join a step; the graph
and the vectors lie in bucketed tables, so a step shuffles the frontier only.
"""

from __future__ import annotations

import math
import uuid
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_whole_groups, small
from .vectors import common_length, matrix, unit, vector_keys

DEGREE = 32
LEAF, TREES = 2000, 6
#: Members of a common neighbour that meet at once; more are dealt into groups, anew in each round.
MEETING = 96
#: A walk also follows the edges by which a vector is among so many best of another, the best of these edges of each.
BACKWARD, MOST_BACKWARD = 8, 32
#: Candidates whose 32-bit score is this near the k-th best are compared exactly, however many; others that follow it: so many.
ROUNDING, FURTHER = 1e-5, 11
#: Rounds and steps after which a warning says that the descent or the walk had not settled.
MOST_ROUNDS, MOST_STEPS = 30, 60
#: Vectors from which the mean is taken that hyperplanes pass through.
SAMPLE = 2000
_LISTS = "a long, vec binary, b array<long>, s array<float>, fresh array<boolean>"


def beam_for(total: int) -> int:
    """Candidates that a walk keeps: more with the rows, by their logarithm."""
    return 8 * math.ceil(math.log2(total + 2))


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` largest s of each a, best first, ties by b."""
    order = np.lexsort((b, -s, a))
    own = a[order]
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[rank < most]


def _lists(a: np.ndarray, b: np.ndarray, s: np.ndarray, fresh: np.ndarray, vec: dict | None = None) -> pa.Table:
    """One row for each a, whose entries follow each other."""
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    ends = pa.array(np.append(start, len(a)), pa.int32())
    own = a[start]
    parts = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (b, s.astype(np.float32), fresh)]
    return pa.table([pa.array(own), pa.array([vec.get(x) for x in own.tolist()] if vec else [None] * len(own), pa.binary()), *parts], names=["a", "vec", "b", "s", "fresh"])


def _flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries (a, b, s, fresh) of a table of lists."""
    b = t["b"].combine_chunks()
    a = np.repeat(t["a"].to_numpy(), b.value_lengths().to_numpy())
    return a, *(t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("b", "s", "fresh"))


def _floats(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.float32).reshape(len(keys), -1)


def neighbour_graph(nodes: DataFrame, scratch: Scratch, total: int, degree: int = DEGREE) -> DataFrame:
    """(a, vec, b, s, fresh): lists of about the ``degree`` nearest b of each node a by cosine s, best first.

    ``nodes``: (id, vec: unit, 32-bit floats). Rounds go on until a round changes at most 1 % of the entries.
    """
    bits = max(0, math.ceil(math.log2(max(1, total / LEAF))))
    few = nodes.where((F.xxhash64("id", F.lit(5)).cast("double") / 2.0**64) + 0.5 < min(1.0, SAMPLE / max(1, total))).select("vec").collect()
    mean = _floats([r["vec"] for r in few]).mean(axis=0) if few else np.float32(0)

    def leaves(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = _floats(batch.column(1).to_pylist()) - mean
            for t in range(TREES if bits else 1):
                planes = np.random.default_rng(100 + t).standard_normal((v.shape[1], bits)).astype(np.float32)
                side = (v @ planes >= 0).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(side * TREES + t), batch.column(0), batch.column(1)], names=["bucket", "id", "vec"])

    placed = scratch.write(nodes.mapInArrow(leaves, "bucket long, id long, vec binary"), "leaves")
    sizes = scratch.write(placed.groupBy("bucket").count().where(F.col("count") > 2 * LEAF), "large_leaves")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.coalesce(F.ceil(F.col("count") / LEAF), F.lit(1))).cast("int")
    placed = placed.join(small(sizes), "bucket", "left").withColumn("part", part)

    def first(t: pa.Table, g: np.ndarray) -> pa.Table | None:
        ids, v, out = t["id"].to_numpy(), _floats(t["vec"].to_pylist()), []
        edges = np.append(np.flatnonzero(np.diff(g, prepend=g[0] - 1)), len(g))
        for s, e in zip(edges[:-1], edges[1:]):
            k = min(degree, e - s - 1)
            for at in range(s, e, 500) if k else ():
                to = min(at + 500, e)
                m = v[at:to] @ v[s:e].T
                m[np.arange(to - at), np.arange(at - s, to - s)] = -2
                near = np.argpartition(-m, k - 1, axis=1)[:, :k]
                out.append((np.repeat(ids[at:to], k), ids[s:e][near].reshape(-1), np.take_along_axis(m, near, 1).reshape(-1)))
        if not out:
            return None
        a, b, s = (np.concatenate(x) for x in zip(*out))
        return _lists(a, b, s, np.ones(len(a), bool))

    dealt = placed.repartition("bucket", "part").sortWithinPartitions("bucket", "part").select("bucket", "part", "id", "vec")
    found = dealt.mapInArrow(lambda it: by_whole_groups(it, ["bucket", "part"], first), _LISTS)
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    bare = nodes.select(F.col("id").alias("a"), "vec", empty("long").alias("b"), empty("float").alias("s"), empty("boolean").alias("fresh"))

    def best(t: pa.Table, g: np.ndarray) -> pa.Table:
        vec = {a: v for a, v in zip(t["a"].to_pylist(), t["vec"].to_pylist()) if v is not None}
        a, b, s, fresh = _flat(t)
        order = np.lexsort((fresh, b, a))  # of equal entries the old one stays
        a, b, s, fresh = a[order], b[order], s[order], fresh[order]
        own = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
        a, b, s, fresh = a[own], b[own], s[own], fresh[own]
        keep = _best(a, b, s, degree)
        lists = _lists(a[keep], b[keep], s[keep], fresh[keep], vec)
        alone = sorted(vec.keys() - set(lists["a"].to_pylist()))
        if not alone:
            return lists
        none = [pa.array([[]] * len(alone), lists.schema.field(c).type) for c in ("b", "s", "fresh")]
        return pa.concat_tables([lists, pa.table([pa.array(alone, pa.int64()), pa.array([vec[x] for x in alone], pa.binary()), *none], names=lists.column_names)])

    def cut(lists: DataFrame, name: str) -> DataFrame:
        dealt = lists.repartition("a").sortWithinPartitions("a")
        return scratch.write(dealt.mapInArrow(lambda it: by_whole_groups(it, ["a"], best, 5000), _LISTS), name)

    graph = cut(found.unionByName(bare), "graph0")
    scratch.drop("leaves")

    def meet(t: pa.Table, g: np.ndarray) -> pa.Table | None:
        ids, fresh, worst = t["id"].to_numpy(), t["fresh"].to_numpy(), t["worst"].to_numpy()
        v = _floats(t["vec"].to_pylist())
        edges, out = np.append(np.flatnonzero(np.diff(g, prepend=g[0] - 1)), len(g)), []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if not fresh[s:e].any():
                continue
            own, at, back = np.unique(ids[s:e], return_index=True, return_inverse=True)  # neighbours of each other come twice
            f = np.bincount(back, fresh[s:e]) > 0
            at += s
            m = v[at] @ v[at].T
            ok = (m > worst[at, None]) & (f[:, None] | f)
            np.fill_diagonal(ok, False)
            x, y = np.nonzero(ok)
            if len(x):
                out.append((own[x], own[y], m[x, y]))
        if not out:
            return None
        a, b, s = (np.concatenate(z) for z in zip(*out))
        keep = _best(a, b, s, degree)
        return _lists(a[keep], b[keep], s[keep], np.ones(len(keep), bool))

    for r in range(1, MOST_ROUNDS + 1):
        edge = graph.select("a", F.explode(F.arrays_zip("b", "fresh")).alias("x")).select("a", "x.b", "x.fresh")
        both = edge.select(F.col("a").alias("bucket"), F.col("b").alias("id"), "fresh").union(edge.select(F.col("b").alias("bucket"), F.col("a").alias("id"), "fresh"))
        active = both.groupBy("bucket").agg(F.max("fresh").alias("any"), F.ceil(F.count("*") / MEETING).cast("int").alias("parts")).where("any").drop("any")
        active = scratch.write(active, f"active{r}")
        carried = graph.select(F.col("a").alias("id"), "vec", F.when(F.size("s") >= degree, F.array_min("s")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        members = both.join(active, "bucket").withColumn("part", F.pmod(F.xxhash64("id", F.lit(r)), F.col("parts")).cast("int")).join(carried, "id")
        members = members.repartition("bucket", "part").sortWithinPartitions("bucket", "part").select("bucket", "part", "id", "fresh", "worst", "vec")
        new = members.mapInArrow(lambda it: by_whole_groups(it, ["bucket", "part"], meet), _LISTS)
        graph = cut(graph.withColumn("fresh", F.transform("fresh", lambda x: F.lit(False))).unionByName(new), f"graph{r}")
        changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        scratch.drop(f"graph{r - 1}", f"active{r}")
        if changed <= 0.01 * degree * total:
            break
    else:
        warnings.warn(f"the graph had not settled after {MOST_ROUNDS} rounds", stacklevel=2)
    return graph


def walk(graph: DataFrame, asked: DataFrame, scratch: Scratch, total: int, beam: int) -> DataFrame:
    """(node, id, s): the ``beam`` best nodes that the walk from each asked node (node, qvec) found, by 32-bit vectors."""
    spark, name = scratch.spark, f"walk_{uuid.uuid4().hex}"
    n = max(4, math.ceil(total / 500_000))

    def bucketed(df: DataFrame, what: str, key: str) -> DataFrame:
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{scratch.base}/{what}").saveAsTable(f"{name}_{what}")
        return spark.table(f"{name}_{what}")

    edge = graph.select("a", F.posexplode(F.arrays_zip("b", "s")).alias("rank", "x")).select("a", "rank", "x.b", "x.s")
    # a hub is among the best of very many: each task keeps its best few edges before they are dealt by hub
    best = Window.partitionBy("b").orderBy(F.desc("s"), "a")
    back = edge.where(F.col("rank") < BACKWARD).withColumn("place", F.row_number().over(best)).where(F.col("place") <= MOST_BACKWARD).select(F.col("b").alias("a"), F.col("a").alias("b"))
    def scored(batches):
        for b in batches:
            if len(b):
                s = np.einsum("ij,ij->i", _floats(b.column(2).to_pylist()), _floats(b.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["node", "id", "s"])

    top = Window.partitionBy("node").orderBy(F.desc("s"), "id")
    start = asked.select("node", F.col("node").alias("id"), F.lit(1.0).cast("float").alias("s"), F.lit(0).alias("open"))
    own = graph.join(asked.select(F.col("node").alias("a")), "a").select(F.col("a").alias("node"), F.explode(F.arrays_zip("b", "s")).alias("x"))
    state = scratch.write(start.unionByName(own.select("node", F.col("x.b").alias("id"), "x.s", F.lit(1).alias("open"))), "walk0")
    try:
        edges = bucketed(edge.select("a", "b").union(back).distinct(), "edges", "a")
        vectors = bucketed(graph.select(F.col("a").alias("id"), "vec"), "vectors", "id")
        for step in range(1, MOST_STEPS + 1):
            opened = state.where("open = 1").select("node", F.col("id").alias("a")).join(edges, "a").select("node", F.col("b").alias("id")).distinct()
            new = opened.join(state.select("node", "id"), ["node", "id"], "left_anti").join(vectors, "id").join(asked, "node")
            new = new.select("node", "id", "vec", "qvec").mapInArrow(scored, "node long, id long, s float")
            merged = state.withColumn("open", F.lit(0)).unionByName(new.withColumn("open", F.lit(1)))
            state = scratch.write(merged.withColumn("r", F.row_number().over(top)).where(F.col("r") <= beam).drop("r"), f"walk{step}")
            scratch.drop(f"walk{step - 1}")
            if not state.where("open = 1").limit(1).count():
                break
        else:
            warnings.warn(f"some walks had not ended after {MOST_STEPS} steps", stacklevel=2)
    finally:
        for what in ("edges", "vectors"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{what}")
    return state.select("node", "id", "s")


def every_pair(asked: DataFrame, nodes: DataFrame, total: int, most: int, block: int = 1000) -> DataFrame:
    """(node, id, s): the ``most`` nearest nodes of each asked node (node, qvec), in blocks of both; for a few asked nodes."""
    nb, ns = (max(1, math.ceil(x / block)) for x in (asked.count(), total))
    deal = lambda c, n: F.pmod(F.xxhash64(c, F.lit(31)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.col("node").alias("id"), F.col("qvec").alias("vec"), F.lit(True).alias("asks"), deal("node", nb).alias("i")).withColumn("j", every(ns))
    right = nodes.select("id", "vec", F.lit(False).alias("asks"), deal("id", ns).alias("j")).withColumn("i", every(nb))

    def work(t: pa.Table, g: np.ndarray) -> pa.Table | None:
        ids, asks, v, out = t["id"].to_numpy(), t["asks"].to_numpy(), _floats(t["vec"].to_pylist()), []
        edges = np.append(np.flatnonzero(np.diff(g, prepend=g[0] - 1)), len(g))
        for s, e in zip(edges[:-1], edges[1:]):
            x, y = s + np.flatnonzero(asks[s:e]), s + np.flatnonzero(~asks[s:e])
            if len(x) and len(y):
                a, b, m = np.repeat(ids[x], len(y)), np.tile(ids[y], len(x)), (v[x] @ v[y].T).reshape(-1)
                keep = _best(a, b, m, most)
                out.append((a[keep], b[keep], m[keep]))
        return pa.table(dict(zip(("node", "id", "s"), map(np.concatenate, zip(*out))))) if out else None

    dealt = left.unionByName(right).repartition("i", "j").sortWithinPartitions("i", "j").select("i", "j", "id", "asks", "vec")
    return dealt.mapInArrow(lambda it: by_whole_groups(it, ["i", "j"], work), "node long, id long, s float")


def nearest(rows: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", beam: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest other rows by cosine, nearest first, ties by id.

    ``is_query`` picks the queries among the rows. Null and zero vectors, those with null or non-finite
    components or of an uncommon length, and rows with a null id take no part. Equal vectors are one node of the
    graph and are told apart at the end, so copies of a query are its nearest. Rows that repeat an id count once for
    each of its vectors and are never their own neighbours. A query for which the walk finds fewer than k rows is
    compared with all, so it gets fewer only where there are no more candidates; an empty table gives none.
    Other columns are not looked at.
    """
    scratch = Scratch(rows.sparkSession, "knn")
    base = rows.select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), vec_col)
    base = scratch.write(vector_keys(base, vec_col, ["id", "q"]).where("id IS NOT NULL AND key IS NOT NULL"), "keys")
    length = common_length(base)
    base = base.where(F.length("key") == length)
    classes = base.groupBy("key").agg(F.min("id").alias("least")).withColumn("node", F.xxhash64("key"))
    classes = scratch.write(classes.select("node", "key"), "classes")
    total = classes.count()
    base = base.withColumn("node", F.xxhash64("key"))
    first = Window.partitionBy("node").orderBy("id")
    some = base.select("node", "id").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("node", "id")
    some = scratch.write(some, "members")
    queries = scratch.write(base.where("q").select(F.col("id").alias("query"), "node", F.col("key").alias("qkey")).distinct(), "queries")

    def units(batches):
        for b in batches:
            if len(b):
                v = unit(matrix(b.column(1).to_pylist())).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary())], names=["id", "vec"])

    nodes = scratch.write(classes.select(F.col("node").alias("id"), "key").mapInArrow(units, "id long, vec binary"), "nodes")
    graph = neighbour_graph(nodes, scratch, total)
    asked = queries.select("node").distinct().join(graph.select(F.col("a").alias("node"), F.col("vec").alias("qvec")), "node")
    asked = scratch.write(asked, "asked")
    state = walk(graph, asked, scratch, total, max(beam or beam_for(total), k + FURTHER))

    def exact(batches):
        for b in batches:
            if len(b):
                s = np.einsum("ij,ij->i", unit(matrix(b.column(2).to_pylist())), unit(matrix(b.column(3).to_pylist())))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["query", "node", "score"])

    def ranked(found: DataFrame) -> DataFrame:
        top = Window.partitionBy("node").orderBy(F.desc("s"), "id")
        near = found.withColumns({"r": F.row_number().over(top), "last": F.nth_value("s", k).over(top.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
        near = near.where((F.col("r") <= k + FURTHER) | (F.col("s") >= F.col("last") - ROUNDING)).select("node", F.col("id").alias("hit"))
        pairs = queries.join(near, "node").join(classes.select(F.col("node").alias("hit"), "key"), "hit").select("query", "hit", "qkey", "key")
        hits = pairs.mapInArrow(exact, "query long, node long, score double").join(some, "node").where("id <> query")
        hits = hits.groupBy("query", "id").agg(F.max("score").alias("score"))
        rank = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return hits.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "id", "score")

    found = scratch.write(ranked(state), "found")
    had = found.groupBy(F.col("query_id").alias("query")).agg(F.count("*").alias("n"))
    short = queries.select("query", "node").join(had, "query", "left").where(F.coalesce("n", F.lit(0)) < k)
    short = scratch.write(short.select("query", "node"), "short")
    if total < 2 or not short.limit(1).count():
        return found
    more = ranked(every_pair(asked.join(short.select("node").distinct(), "node"), nodes, total, max(beam_for(total), k + FURTHER)))
    again = short.select(F.col("query").alias("query_id")).distinct()
    return found.join(again, "query_id", "left_anti").unionByName(more.join(again, "query_id", "left_semi"))


def op8_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = nearest(rows, F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
