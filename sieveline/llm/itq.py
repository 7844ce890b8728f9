"""Embedding near-duplicates by iterative quantisation.

Rotations of the principal components are learned so that their signs are balanced binary codes, four of 64 bits. The
bits are cut into substrings, one hash table each (multi-index Hamming tables), and shuffled and cut again until a pair at
the threshold meets in some table with the chance asked for. A vector stands once in each table. Substrings grow with
the logarithm of the rows, so a bucket stays of about a thousand vectors and the tables of a vector grow slowly: 12 for ten
thousand rows of a label, 17 for a million, 96 for a thousand million.

The tables hold ids and codes only. Pairs within a Hamming radius are candidates; the vectors of candidates alone are
joined to their buckets and compared by cosine. A pair that meets in several buckets counts in one of them only, so
links are counted in the tasks and never listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_whole_groups, connected_components, forest, in_blocks, pairs_in_groups
from .vectors import common_length, matrix, unit, vector_keys

COSINE = 0.93
#: Bits of a code, and rotations.
BITS, TURNS = 64, 4
#: Differing bits of all codes up to which a pair is compared: 31 on average at the threshold, 128 for unlike vectors.
RADIUS = 72
#: A bucket of unlike vectors holds about 2^BUCKET of them, and a substring has this many bits at least.
BUCKET, LEAST_WIDTH = 10, 8
SAMPLE = 20_000
#: The chance to meet that the tables are made for, at the threshold.
RECALL = 0.99


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of unit vectors ``x``: the signs of (v - mean) @ projection are the code."""
    mean = x.mean(axis=0)
    r = np.random.default_rng(seed)
    if len(x) < 2:
        return mean, r.standard_normal((x.shape[1], bits))
    _, w = np.linalg.eigh((x - mean).T @ (x - mean))
    w = w[:, ::-1][:, :bits]
    if w.shape[1] < bits:  # fewer dimensions than bits: more directions of the same space
        w = np.concatenate([w, r.standard_normal((x.shape[1], bits - w.shape[1])) / np.sqrt(x.shape[1])], axis=1)
    v = (x - mean) @ w
    turn = np.linalg.qr(r.standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, t = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ t).T
    return mean, w @ turn


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """64-bit codes of unit vectors."""
    bits = (x - mean) @ projection >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def substrings(most: int, cosine: float = COSINE) -> tuple[int, int]:
    """(bits of a substring, tables) for the ``most`` vectors of one label.

    A bit differs with probability arccos(cosine) / pi. A table misses a pair unless none of its bits is among those
    that differ; there are as many tables as bring the chance that all miss it, over the numbers of bits that may
    differ, to 1 - RECALL.
    """
    width = min(32, max(LEAST_WIDTH, math.ceil(math.log2(max(2, most))) - BUCKET))
    bits, p = BITS * TURNS, math.acos(cosine) / math.pi
    odd = np.arange(bits + 1)
    weight = np.array([math.comb(bits, d) * p**d * (1 - p) ** (bits - d) for d in odd.tolist()])
    meet = np.array([math.comb(bits - d, width) / math.comb(bits, width) for d in odd.tolist()])
    tables = 1
    while (weight * (1 - meet) ** tables).sum() > 1 - RECALL:
        tables += 1
    return width, tables


def table_masks(width: int, tables: int, seed: int = 17) -> np.ndarray:
    """(tables, TURNS) words: the bits of each table's substring, cut from shuffles of all bits."""
    r, out, per = np.random.default_rng(seed), np.zeros((tables, TURNS), np.uint64), BITS * TURNS // width
    for k in range(tables):
        if k % per == 0:
            order = r.permutation(BITS * TURNS)
        for bit in order[k % per * width : (k % per + 1) * width].tolist():
            out[k, bit // BITS] |= np.uint64(1 << bit % BITS)
    return out


def linked_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", cosine: float = COSINE, sample: int = SAMPLE, block: int = 512) -> DataFrame:
    """(id, n_links, component_id) of each row.

    Vectors link when their labels are equal and not null and their cosine is at least ``cosine``. Equal vectors
    are one class, compared once. Null vectors, zero vectors, those with null or non-finite components or of an
    uncommon length, and rows with a null label or id, link with nothing: n_links is 0, the component their own
    id. Rows that repeat an id are vectors of their own. An empty table gives an empty result; other columns are not
    looked at. The rotations are learned from about ``sample`` classes; every vector is in the tables. Pairs that meet
    in no table are lost, so this is approximate.
    """
    scratch = Scratch(rows.sparkSession, "itq")
    label = F.lit(0) if label_col is None else F.col(label_col)
    base = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), vec_col)
    base = scratch.write(vector_keys(base, vec_col, ["id", "label"]), "keys")
    length = common_length(base)
    usable = F.coalesce((F.length("key") == length) & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    cls = F.xxhash64("label", "key")
    classes = base.where(usable).groupBy("label", "key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = scratch.write(classes.select(cls.alias("cls"), F.xxhash64("label").alias("lab"), "key", "least", "n"), "classes")
    by_label = classes.groupBy("lab").count()
    total, most = by_label.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    few = classes.where((F.xxhash64("cls", F.lit(9)).cast("double") / 2.0**64) + 0.5 < min(1.0, sample / max(1, total))).select("key")
    taken = [bytes(r["key"]) for r in few.collect()]
    if not taken:
        taken = [bytes(r["key"]) for r in classes.select("key").limit(1).collect()]
    masks = table_masks(*substrings(most, cosine))
    models = [learn_rotation(unit(matrix(taken)), seed=2 + k) if taken else (np.zeros(1), np.zeros((1, BITS))) for k in range(TURNS)]
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def coded(keys: list[bytes]) -> np.ndarray:
        """Codes (vectors, rotations)."""
        v = unit(matrix(keys))
        return np.stack([codes(v, *m) for m in shared.value], axis=1)

    def spread(batches):
        mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
        for b in (x.slice(at, 2000) for x in batches for at in range(0, len(x), 2000)):
            c = coded(b.column(2).to_pylist())
            key = c[:, None, :] & masks  # a row for each table
            key ^= key >> np.uint64(31)
            key = (key * mix).sum(axis=2, dtype=np.uint64)
            many, table = np.repeat(np.arange(len(b)), len(masks)), np.tile(np.arange(len(masks), dtype=np.int32), len(b))
            parts = {"id": b.column(0).to_numpy()[many], "lab": b.column(1).to_numpy()[many], "slot": table, "part": key.reshape(-1).view(np.int64)}
            yield pa.RecordBatch.from_pydict(parts | {f"c{k}": c[many, k].view(np.int64) for k in range(TURNS)})

    names = [f"c{k}" for k in range(TURNS)]
    kinds = "lab long, slot int, " + ", ".join(f"{c} long" for c in names)
    dealt = classes.select(F.col("cls").alias("id"), "lab", "key").mapInArrow(spread, f"id long, {kinds.replace('slot int', 'slot int, part long')}").withColumn("bucket", F.xxhash64("lab", "slot", "part")).drop("part")

    def here(c: np.ndarray, a: np.ndarray, b: np.ndarray, slot: np.ndarray, lab: np.ndarray) -> np.ndarray:
        """Whether this bucket is that of the first table in which the pair a, b meets."""
        odd, out = c[a] ^ c[b], (slot[a] == slot[b]) & (lab[a] == lab[b])
        for at in range(0, len(a), 50_000):
            near = ((odd[at : at + 50_000, None, :] & masks) == 0).all(axis=2)
            out[at : at + 50_000] &= near.any(axis=1) & (np.argmax(near, axis=1) == slot[a[at : at + 50_000]])
        return out

    def columns(t: pa.Table):
        return np.stack([t[k].to_numpy().view(np.uint64) for k in names], axis=1), t["slot"].to_numpy(), t["lab"].to_numpy()

    def candidates(t: pa.Table, g: np.ndarray) -> pa.Table | None:
        (c, slot, lab), (own, i, j) = columns(t), (t[k].to_numpy() for k in ("own", "i", "j"))
        found = [np.empty(0, np.int64)]
        for a, b in pairs_in_groups(g, own, i, j):
            near = np.bitwise_count(c[a] ^ c[b]).sum(axis=1) <= RADIUS
            a, b = a[near], b[near]
            ok = here(c, a, b, slot, lab)
            found += [a[ok], b[ok]]
        at = np.unique(np.concatenate(found))
        return t.take(pa.array(at)) if len(at) else None

    cols = ["bucket", "i", "j", "own", "id", "lab", "slot", *names]
    near = in_blocks(dealt, scratch, "tables", block).select(*cols)
    near = near.mapInArrow(lambda it: by_whole_groups(it, ["bucket", "i", "j"], candidates, 8192), f"bucket long, i int, j int, own int, id long, {kinds}")
    near = scratch.write(near, "near")

    def work(t: pa.Table, g: np.ndarray) -> pa.Table | None:
        (c, slot, lab), (own, i, j, n, ids) = columns(t), (t[k].to_numpy() for k in ("own", "i", "j", "n", "id"))
        v, links, found = unit(matrix(t["key"].to_pylist())), np.zeros(len(t), np.int64), []
        edges = np.append(np.flatnonzero(np.diff(g, prepend=g[0] - 1)), len(g)).tolist()
        for s, e in zip(edges[:-1], edges[1:]):
            a, b = (x + s for x in np.nonzero(np.triu(v[s:e] @ v[s:e].T >= cosine, 1)))
            ok = (i[s] == j[s]) | (own[a] != own[b])
            ok &= np.bitwise_count(c[a] ^ c[b]).sum(axis=1) <= RADIUS
            a, b = a[ok], b[ok]
            ok = here(c, a, b, slot, lab)
            a, b = a[ok], b[ok]
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            found.append((a, b))
        if not links.any():
            return None
        root = forest(len(t), np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
        at = np.flatnonzero(links)
        return pa.table({"a": ids[at], "b": ids[root[at]], "links": links[at]})

    met = near.join(classes.select(F.col("cls").alias("id"), "key", "n"), "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").select(*cols, "n", "key")
    found = met.mapInArrow(lambda it: by_whole_groups(it, ["bucket", "i", "j"], work, 4096), "a long, b long, links long")
    found = scratch.write(found, "links")
    roots = scratch.write(connected_components(found.select("a", "b"), scratch), "roots")
    links = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    known = classes.select("cls", "least", "n").join(links, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    known = scratch.write(known.withColumn("root", F.coalesce("root", "cls")), "known")
    least = scratch.write(known.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    known = known.join(least, "root").select("cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    known = scratch.write(known, "members")
    joined = base.where(usable).withColumn("cls", cls).join(known, "cls").select("id", "n_links", "component_id")
    return joined.unionByName(base.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
