"""Substring deduplication: content-defined chunks cut by a gear rolling hash, deduplicated by digest.

The gear hash of a place depends on the 16 bytes before it, so the same passage is cut alike wherever it stands
and an insertion moves only the cuts next to it. Chunks with equal 128-bit digests are copies; the first one by
(id, place) stays. Where the bytes before or after a copy are those around the first one, the copy grows by them in
steps, told by hashes that each chunk carries of its surroundings; adjoining copies in a text are joined to spans, and
spans of at least ``min_bytes`` are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

MASK_BITS = 5
MIN_CHUNK = 12
MAX_CHUNK = 160
MIN_BYTES = 120
#: Bytes of a step and steps by which a span may grow beyond its chunks at each end.
STEP = 32
STEPS = 2


def gear(seed: int = 3) -> np.ndarray:
    """A random 16-bit number for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 16, 256).astype(np.uint16)


_GEAR = gear()
_WIDE = np.random.default_rng(5).integers(0, 1 << 32, 256).astype(np.uint32)


def cuts(data: bytes, mask_bits: int = MASK_BITS, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> np.ndarray:
    """End of each chunk of ``data``, the last one its length.

    A place is a candidate when the top bits of its hash (h = 2h + gear, 16 bits, so 16 bytes count) are zero. A
    candidate closer than ``least`` to the one before it does not cut, which is decided by content alone, and
    stretches of over ``most`` bytes without a cut are cut every ``most`` bytes from their start.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8):
        later = h[shift:] + (h[:-shift] << np.uint16(shift))
        h = np.concatenate([h[:shift], later])
    at = np.flatnonzero(h >> np.uint16(16 - mask_bits) == 0) + 1
    at = at[(at >= 16) & (at < n)]
    if len(at):
        at = at[np.diff(at, prepend=-least) >= least]
    edges = np.concatenate([[0], at, [n]])
    gaps = np.diff(edges)
    if gaps.max() > most:
        inner = (gaps - 1) // most
        first = np.repeat(edges[:-1], inner)
        k = np.arange(len(first)) - np.repeat(np.cumsum(inner) - inner, inner) + 1
        edges = np.unique(np.concatenate([edges, first + k * most]))
    return edges[1:]


def step_hashes(data: np.ndarray) -> np.ndarray:
    """A hash, 1 to 65,535, of the STEP bytes that end at each place of ``data`` (0 to its length); 0 where there are fewer."""
    out = np.zeros(len(data) + 1, np.uint16)
    power = lambda n: np.uint32(pow(0x9E3779B1, n, 1 << 32))
    for at in range(STEP, len(data) + 1, 1 << 22):
        h = _WIDE[data[at - STEP : at + (1 << 22) - 1]]
        n = len(h) - STEP + 1
        # one, two, four and eight bytes that end at a place, then eight at a time
        for k in (1, 2, 4):
            h = h[k:] + h[:-k] * power(k)
        whole = sum(h[k : k + n] * power(STEP - 8 - k) for k in range(0, STEP, 8))
        out[at : at + n] = np.maximum(whole >> np.uint32(16), 1)
    return out


def around(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the STEPS steps before each chunk's start and, in higher bits, of those after its end; nearest lowest."""
    edge = np.zeros(STEP * STEPS, np.uint16)
    hashes = np.concatenate([edge, step_hashes(data), edge])
    end = ends + STEP * STEPS
    start = np.concatenate([[STEP * STEPS], end])[: len(end)]
    sides = np.zeros(len(end), np.int64)
    for k in range(STEPS):
        sides |= hashes[start - k * STEP].astype(np.int64) << np.int64(16 * k)
        sides |= hashes[end + (k + 1) * STEP].astype(np.int64) << np.int64(16 * (STEPS + k))
    return sides


def chunk_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dig, pos, len, hi, lo, sides): byte place, length, digest and surroundings of each chunk of the UTF-8
    text; dig is the text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for at in range(0, len(batch), 1000):
                b = batch.slice(at, 1000)
                ends, counts, hashes, sides = [], [], [], []
                for t in b.column(2).to_pylist():
                    data = (t or "").encode("utf-8", "surrogatepass")
                    e = cuts(data)
                    ends.append(e)
                    counts.append(len(e))
                    sides.append(around(np.frombuffer(data, np.uint8), e))
                    s = 0
                    for x in e.tolist():
                        hashes.append(digest(data[s:x]))
                        s = x
                if not hashes:
                    continue
                end = np.concatenate(ends)
                start = np.concatenate([np.concatenate([[0], e[:-1]]) for e in ends if len(e)])
                d = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
                rows = pa.array(np.repeat(np.arange(len(b)), counts))
                values = [start.astype(np.int32), (end - start).astype(np.int32), np.ascontiguousarray(d[:, 0]), np.ascontiguousarray(d[:, 1]), np.concatenate(sides)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *map(pa.array, values)], names=["id", "dig", "pos", "len", "hi", "lo", "sides"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("dig"), text.alias("text")).mapInArrow(run, "id long, dig long, pos int, len int, hi long, lo long, sides long")


def _same(slot: int) -> Column:
    """Bytes of the steps from ``slot`` on, nearest first, whose hashes are those around the first copy."""
    at = lambda c, k: F.shiftrightunsigned(c, 16 * (slot + k)).bitwiseAND(F.lit(0xFFFF))
    differs = [F.when((at("sides", k) != at("first_sides", k)) | (at("sides", k) == 0), k * STEP) for k in range(STEPS)]
    return F.coalesce(*differs, F.lit(STEPS * STEP))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, start, n_bytes, n_chunks, first_id, first_start): each span of a text that stands earlier, too.

    ``start`` and ``n_bytes`` are byte places in the UTF-8 text; (first_id, first_start) is where the span's first
    bytes stand first, by id and place. The first copy itself is no repeat. A span's ends are short of the true ones by
    less than a step, or by more where over STEPS steps lie between the true end and the nearest cut; a step of other
    bytes passes with a chance of 1 in 65,536. Spans of a text do not overlap. Null and empty texts and texts
    without a repeat give no row; rows with a null id come first in order, rows of one id by a digest of their text;
    a row that repeats both an id and its text gives no span of its own. Texts of any length count whole, their repeats
    within themselves too. An empty table gives no rows; other columns are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    chunks = scratch.write(chunk_table(docs, id_col, text_col), "chunks")
    groups = chunks.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min(F.struct("id", "dig", "pos")).alias("first"))
    groups = scratch.write(groups.where("n > 1").select("hi", "lo", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("id", "dig", "pos")]), "groups")
    same_text = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("dig") == F.col("first_dig"))
    shared = scratch.write(chunks.join(groups, ["hi", "lo"]).withColumn("is_first", same_text & (F.col("pos") == F.col("first_pos"))), "shared")
    # written, so that the join reads both sides from shuffles and Spark can split a chunk of very many copies
    firsts = scratch.write(shared.where("is_first").groupBy("hi", "lo").agg(F.first("sides").alias("first_sides")), "firsts")
    copies = shared.where("NOT is_first").join(firsts, ["hi", "lo"])
    # within one text, a copy does not grow over the first one
    room = F.when(same_text, F.greatest(F.col("pos") - F.col("first_pos") - F.col("len"), F.lit(0)))
    copies = copies.select("id", "dig", "pos", (F.col("pos") + F.col("len")).alias("end"), "first_id", "first_pos", F.least(_same(0), room).alias("left"), _same(STEPS).alias("right"))
    copies = copies.dropDuplicates(["id", "dig", "pos"])
    by_place = Window.partitionBy("id", "dig").orderBy("pos")
    copies = copies.withColumn("right", F.least("right", F.lead("pos").over(by_place) - F.col("end")))
    before = F.lag(F.col("end") + F.col("right")).over(by_place)
    copies = copies.withColumn("before", before).withColumn("left", F.least("left", F.col("pos") - F.col("before")))
    new = F.coalesce((F.col("before") != F.col("pos") - F.col("left")).cast("int"), F.lit(1))
    run = copies.withColumn("new", new).withColumn("run", F.sum("new").over(by_place))
    spans = run.groupBy("id", "dig", "run").agg(
        F.min(F.col("pos") - F.col("left")).alias("start"),
        F.max(F.col("end") + F.col("right")).alias("end"),
        F.count("*").alias("n_chunks"),
        F.min_by("first_id", "pos").alias("first_id"),
        F.min_by(F.col("first_pos") - F.col("left"), "pos").alias("first_start"),
    )
    spans = spans.select("id", "start", (F.col("end") - F.col("start")).cast("long").alias("n_bytes"), "n_chunks", "first_id", "first_start")
    return spans.where(F.col("n_bytes") >= min_bytes)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = repeated_spans(docs)
    return found.select(F.col("id").alias("doc_id"), "start", "n_bytes", "n_chunks", F.col("first_id").alias("first_doc_id"), "first_start")
