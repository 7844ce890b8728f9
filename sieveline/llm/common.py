"""Pieces that several corpus operators share: intermediate tables, bucketed pair tests, connected components.

Intermediate results go to the folder that the session names in ``spark.checkpoint.dir``; every executor
can read them there, so a lost executor costs a re-read and never a recomputation of what came before.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []

#: Words as the contracts define them: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: A table of at most so many short rows may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder; a fresh local one where none is set and the session runs in one process, as in tests."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="sieveline-"))
    return _LOCAL_ROOT[0]


class Scratch:
    """Tables written to the shared folder to cut lineage; each name is used once per scratch."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base = spark, f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession, hours: float) -> list[str]:
    """Remove the folders of scratches in the shared folder that nothing was written to for so many hours; returns their names.

    A result may still read its operator's tables, so they stay until someone says that no result of that age is in use.
    """
    jvm, root = spark._jvm, shared_root(spark)
    at = jvm.org.apache.hadoop.fs.Path(root)
    files, gone = at.getFileSystem(spark._jsc.hadoopConfiguration()), []
    before = time.time() * 1000 - hours * 3_600_000
    for status in files.listStatus(at) if files.exists(at) else []:
        name = status.getPath().getName()
        if re.fullmatch(r"[a-z-]+-[0-9a-f]{32}", name) and status.getModificationTime() <= before:
            inner = [s.getModificationTime() for s in files.listStatus(status.getPath())]
            if max(inner, default=0) <= before:
                files.delete(status.getPath(), True)
                gone.append(name)
    return gone


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with underscores added until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has at most so many rows, which are counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


_HELD: dict[tuple, object] = {}


def held_in_worker(kind: str, key: object, make: Callable[[], object]) -> object:
    """A model kept between tasks of one Python worker. It holds one at a time: another operator's goes first."""
    if (kind, key) not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[kind, key] = make()
    return _HELD[kind, key]


def held_out(doc_id) -> F.Column:
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, group: str, key: str, most: int | dict, seed: int, groups: int = 1000) -> DataFrame:
    """About ``most`` rows of each group, chosen by a hash of the key: the share that a count of the group allows.

    Rows of a null group are left out, as are those of all but the ``groups`` largest groups (ties by the group), so
    that a dirty column makes neither the counts on the driver nor the sample large.
    """
    rows = rows.where(F.col(group).isNotNull())
    counts = rows.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(groups).collect()
    if not counts:
        return rows
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r[group], min(1.0, (most[r[group]] if isinstance(most, dict) else most) / r["n"]))]), F.col(group))
    rows = rows.where(F.col(group).isin([r[group] for r in counts]))
    return rows.where((F.xxhash64(F.col(key), F.lit(seed)).cast("double") / 2.0**64) + 0.5 < share)


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b long): root is the least node that it reaches.

    Alternating large-star and small-star rounds. Minima are taken by partial aggregation and written
    before they are joined back, so the join has two plain shuffled sides and a star's centre can be split.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.write(e, "cc0")
    seen = _digest(e)
    for k in range(1, most_rounds + 1):
        if seen[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = scratch.write(low, f"cc{k}large")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, f"cc{k}half")
        low = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"cc{k}small")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.write(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"cc{k}")
        scratch.drop(f"cc{k - 1}", f"cc{k}large", f"cc{k}half", f"cc{k}small")
        before, seen = seen, _digest(e)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _digest(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def cut_blocks(rows: DataFrame, scratch: Scratch, name: str, block: int) -> DataFrame:
    """``rows`` (bucket long, id, and more) by groups in which each pair of one bucket's rows meets.

    Buckets of more than ``block`` rows are cut into blocks by a hash of ``id``, and every pair of blocks is a
    group of its own: no task gets a whole large bucket and no pair is lost. Adds columns i, j (the group's
    blocks) and own (the row's). Buckets of one row are left out.
    """
    counts = scratch.write(rows.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1"), f"{name}_counts")
    cut = rows.join(counts, "bucket").withColumn("_nb", F.ceil(F.col("_n") / block).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("id", F.lit(17)), F.col("_nb")).cast("int"))
    cut = cut.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return cut.withColumn("i", F.least("own", "_k")).withColumn("j", F.greatest("own", "_k")).drop("_n", "_nb", "_k")


def in_blocks(rows: DataFrame, scratch: Scratch, name: str, block: int) -> DataFrame:
    """``cut_blocks`` dealt over tasks, each group in one task and sorted by (bucket, i, j)."""
    return cut_blocks(rows, scratch, name, block).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def by_whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table | None], most: int = 20_000
) -> Iterator[pa.RecordBatch]:
    """Call ``work(table, group number of each row)`` on runs of whole groups of a key-sorted stream."""

    def groups(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        for k in keys:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    def out(t: pa.Table, g: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(t) and (r := work(t, g)) is not None and len(r):
            yield from r.combine_chunks().to_batches()

    held: pa.Table | None = None
    for batch in batches:
        for at in range(0, len(batch), most):
            piece = pa.Table.from_batches([batch.slice(at, most)])
            t = piece if held is None else pa.concat_tables([held, piece]).combine_chunks()
            g = groups(t)
            cut = int(np.searchsorted(g, g[-1]))
            yield from out(t.slice(0, cut), g[:cut])
            held = t.slice(cut)
    if held is not None and len(held):
        yield from out(held, groups(held))


def pairs_in_groups(g: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one group, once each; of two different blocks where the group joins two blocks."""
    n, at = len(g), np.arange(len(g))
    step = 1
    while step < n:
        at = at[at < n - step]
        at = at[g[at] == g[at + step]]
        if not len(at):
            return
        ok = (i[at] == j[at]) | (own[at] != own[at + step])
        if ok.any():
            yield at[ok], at[ok] + step
        step += 1


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that it reaches over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label
