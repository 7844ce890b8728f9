"""Vector code compression: product quantisation whose nearest entries are found by Orchard's search.

Vectors become integers, so that codebooks and errors are exact whatever the order of the sums. Each codebook keeps,
for every entry, the other entries sorted by distance. A search goes along the list of its best entry; a nearer entry
takes over with its own list; entries seen are marked; the search ends where the list is farther from the best entry
than twice the best distance, as no entry beyond can be as near. Searches of many vectors run side by side, some
entries of each list at a time. A round of codebook training is one pass over the vectors, whose tasks send only the
sums and counts of the entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are integers within this bound (values within 32,768), so that squared distances fit 64 bits.
MOST = 1 << 25
#: Vectors searched side by side, and entries of a list looked at in one step.
ROWS, STEP = 2048, 16


class Codebook:
    """Entries of one part (rows of int64), each with its distance-sorted list of all entries, itself first."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n = len(entries)
        far = np.stack([np.einsum("ij,ij->i", d, d) for d in (entries - e for e in entries)]) if n else np.zeros((0, 0), np.int64)
        self.lists = np.argsort(far, axis=1, kind="stable")
        # the first of equal entries leads its list as well
        self.far = np.take_along_axis(far, self.lists, axis=1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry, ties to the lower index."""
        n, k = len(rows), len(self.entries)
        start = (rows - self.entries[0]) if k else rows
        best, dist = np.zeros(n, np.int64), np.einsum("ij,ij->i", start, start)
        seen = np.zeros((n, k), bool)
        seen[:, :1] = True
        place, open_ = np.zeros(n, np.int64), np.arange(n)
        while len(open_):
            at = place[open_, None] + np.arange(STEP)
            inside = at < k
            np.minimum(at, k - 1, out=at)
            entry = self.lists[best[open_, None], at]
            # distances are squares, so twice the distance is four times
            near = inside & (self.far[best[open_, None], at] <= 4 * dist[open_, None])
            look = near & ~seen[open_[:, None], entry]
            r, c = np.nonzero(look)
            own, e = open_[r], entry[r, c]
            seen[own, e] = True
            d = rows[own] - self.entries[e]
            d = np.einsum("ij,ij->i", d, d)
            better = (d < dist[own]) | (d == dist[own]) & (e < best[own])
            own, e, d = own[better], e[better], d[better]
            order = np.lexsort((e, d, own))
            own, e, d = own[order], e[order], d[order]
            lead = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.empty(0, bool)
            best[own[lead]], dist[own[lead]] = e[lead], d[lead]
            place[open_] += STEP
            place[own[lead]] = 0  # jump to the list of the improved entry
            jumped = np.zeros(n, bool)
            jumped[own[lead]] = True
            open_ = open_[jumped[open_] | near[:, -1] & (place[open_] < k)]
        return best, dist


def quantised(rows: DataFrame, vec_col: str, others: list[str], length: int) -> DataFrame:
    """``others`` and v: the vector's components as 32-bit integers floor(SCALE x), with zeros up to a multiple of PARTS."""
    width = -(-length // PARTS) * PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.zeros((len(b), width), np.int32)
            if length:
                flat = b.column(len(others)).flatten().to_numpy(zero_copy_only=False).reshape(len(b), length)
                v[:, :length] = np.clip(np.floor(SCALE * np.clip(flat, -MOST, MOST)), -MOST, MOST)
            raw = v.tobytes()
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(others))), pa.array([raw[4 * width * k : 4 * width * (k + 1)] for k in range(len(b))], pa.binary())], names=[*others, "v"])

    base = rows.select(*others, F.col(vec_col).cast("array<double>").alias("_vec"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{schema}v binary")


def _parts(column: pa.Array, width: int) -> np.ndarray:
    """Rows by part: (PARTS, rows, width / PARTS) of int64."""
    m = np.frombuffer(b"".join(column.to_pylist()), np.int32).astype(np.int64).reshape(len(column), PARTS, width // PARTS)
    return m.transpose(1, 0, 2)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _round(data: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with each entry replaced by the floor of the mean of its parts; entries without any stay."""
    width = books.shape[0] * books.shape[2]
    each = books.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in _slices(batches):
            for p, rows in enumerate(_parts(batch.column(0), width)):
                code, _ = made[p].nearest(rows)
                np.add.at(total[p], code, rows)
                count[p] += np.bincount(code, minlength=len(books[p]))
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p * ENTRIES + e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["slot", "n", "s"])

    found = data.select("v").mapInArrow(sums, "slot long, n long, s array<long>")
    found = found.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(each)])
    out = books.copy()
    for row in found.collect():  # a row per entry at most
        out[row["slot"] // ENTRIES, row["slot"] % ENTRIES] = [row[f"s{k}"] // row["n"] for k in range(each)]
    return out


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) per usable vector, and the codebooks, an array (part, entry, component).

    Vectors that are null or hold null or non-finite components are dropped. The most frequent length, the shorter of
    equally frequent ones, is the table's; vectors of another length are dropped, too, and a length that four does not
    divide is filled with zeros. Zero vectors and repeated rows are vectors like any other. Codebooks start from the
    256 smallest ids, null last, repeated ids by their components; a table of fewer vectors has codebooks of so many
    entries, an empty one an empty result. Components beyond 32,768 count as that. Columns of other names are not read.
    """
    scratch = Scratch(rows.sparkSession, "orchard")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull() & ~F.exists("vec", bad))
    row = kept.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = row["n"] if row else 0
    data = scratch.write(quantised(kept.where(F.size("vec") == length), "vec", ["id", "label"], length), "vectors")
    width = -(-length // PARTS) * PARTS
    first = data.orderBy(F.asc_nulls_last("id"), "v").limit(ENTRIES).select("v").toArrow()["v"].combine_chunks()
    books = np.ascontiguousarray(_parts(first, width))
    for _ in range(ROUNDS):
        books = _round(data, books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books]
        for batch in _slices(batches):
            if not len(batch):
                continue
            found = [made[p].nearest(x) for p, x in enumerate(_parts(batch.column(2), width))]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            step = 2 * PARTS
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([codes[step * k : step * (k + 1)] for k in range(len(batch))]), pa.array(sum(d for _, d in found))], names=["id", "label", "code", "error"])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in data.schema.fields[:2])
    return scratch.write(data.select("id", "label", "v").mapInArrow(assign, f"{schema}code string, error long"), "codes"), books


def books_digest(books: np.ndarray) -> str:
    """Digest of all components by part, entry and place, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    found = codes.join(small(by_label), F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    near = "list_inner_product(c, c) - 2 * list_inner_product(x.v, c)"
    steps = [f"b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES}))"]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, min(struct_pack(d := {near} + list_inner_product(x.v, x.v), e := e)) AS m FROM x JOIN b{r} USING (p) GROUP BY vec_id, p)")
        if r < ROUNDS:
            steps.append(f"s{r} AS (SELECT p, e, j, sum(CAST(y AS BIGINT)) AS s, count(*) AS n FROM (SELECT p, m.e AS e, unnest(v) AS y, generate_subscripts(v, 1) AS j FROM x JOIN a{r} USING (vec_id, p)) GROUP BY p, e, j)")
            steps.append(f"m{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) / n AS DOUBLE) ORDER BY j) AS c FROM s{r} GROUP BY p, e)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, e))")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * CAST(y AS DOUBLE))) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM k, range({PARTS}) r(p)),
{", ".join(steps)},
f AS (SELECT vec_id, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
l AS (SELECT label, sum(error) AS label_error FROM f JOIN k USING (vec_id) GROUP BY label),
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS j FROM b{ROUNDS}))
SELECT f.vec_id, f.code, f.error, CAST(l.label_error AS BIGINT) AS label_error, h.codebooks_sha256
FROM f JOIN k USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM k.label, h
"""


OP13_SQL = _sql()
