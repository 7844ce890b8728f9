"""Factors of large sparse matrices: singular vectors of weighted terms, and topics as non-negative factors.

A matrix is a table of parts: the entries of a range of columns, column by column, as compressed bytes of about four bytes
an entry. A pass over it brings the parts of a group the vectors of all rows, of as many components at a time as keep the
task small, and adds up what the groups give. The columns' vectors are made and used part by part: where only the rows'
are wanted, none are written. Matrices of rank times rank alone come to the driver, and tables that a step no longer needs go.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import Files, folder

#: Entries of a part, about; texts' words that a task sorts at a time; rows of a block of vectors.
TILE, WORDS_HELD, BLOCK = 2_000_000, 1 << 19, 4096
#: Bytes of vectors that a task of a pass holds, and that a pass may send beside the matrix whatever that one's size.
HELD, SENT = 192_000_000, 256_000_000
WORDS, LETTERS = r"\b\w\w+\b", r"\b[a-z][a-z]+\b"
#: Vectors at the interface have a row each, as the bytes of their 64-bit floats; within, a block of rows or a part of columns.
_VECTORS, _BLOCKS, _PARTS = "key long, vec binary", "block int, data binary", "part int, keys binary, data binary"
_CELLS = "part int, n long, keys binary, runs binary, scale binary, rows binary, vals binary"
_CODES = "part int, base long, keys binary, runs binary, rows binary, vals binary"


@contextlib.contextmanager
def _frugal(spark: SparkSession) -> Iterator[None]:
    """Jobs whose shuffle files go when they end, and whose batches of large rows are small."""
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 23)}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _written(df: DataFrame, path: str, codec: str = "uncompressed") -> DataFrame:
    """``df`` written to ``path``, beside what is there, and read back; nothing else of the job stays on disk."""
    with _frugal(df.sparkSession):
        df.write.option("compression", codec).mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _squeezed(a: np.ndarray) -> bytes:
    """Numbers as compressed bytes, those of equal weight together."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
    return a.dtype.char.encode() + len(planes).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _restored(b: bytes) -> np.ndarray:
    kind, size = np.dtype(chr(b[0])), int.from_bytes(b[1:9], "little")
    if not size:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(b[9:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences, from the first number on; ``np.cumsum`` gives the numbers back."""
    return np.diff(a, prepend=a.dtype.type(0))


def _starts(runs: np.ndarray) -> np.ndarray:
    return np.cumsum(runs) - runs


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of a column: keys as unsigned numbers, cut into ranges."""
    return ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _coded(keys: np.ndarray, rows: np.ndarray) -> tuple[bytes, bytes, bytes, np.ndarray]:
    """(keys, runs, rows as bytes, runs) of entries in the order of their keys."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    runs = np.diff(at, append=len(keys)).astype(np.int32)
    return _squeezed(_steps(keys[at])), _squeezed(runs), _squeezed(_steps(rows.astype(np.int32))), runs


def _small(n: np.ndarray) -> np.ndarray:
    return n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32)


def _weighed(vals: np.ndarray, logs: bool) -> np.ndarray:
    """Values as numbers; with ``logs`` they are counts, from 1 on."""
    if not logs:
        return vals.astype(np.float64)
    return (1.0 + np.log(np.arange(vals.max(initial=1) + 1).clip(1))).take(vals, mode="clip") if vals.max(initial=1) < 1 << 16 else 1.0 + np.log(vals)


def _rows(vec: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vec), np.float64).reshape(len(vec), -1)


def _vectors(key: pd.Series | np.ndarray, m: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"key": np.asarray(key, np.int64), "vec": [x.tobytes() for x in np.ascontiguousarray(m, np.float64)]})


def arrays(vectors: DataFrame) -> DataFrame:
    """(key, vec) with vec as an array of numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"key": f["key"], "vec": list(_rows(f["vec"]))})

    return vectors.select("key", "vec").mapInPandas(run, "key long, vec array<double>")


def _by_row(blocks: DataFrame, size: int) -> DataFrame:
    """(key, vec) of each row, by its number, from blocks of ``size`` components."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block, data in zip(f["block"], f["data"]):
                yield _vectors(block * BLOCK + np.arange(BLOCK), _matrix(data, size).T)

    return blocks.select("block", "data").mapInPandas(run, _VECTORS)


def _by_column(parts: DataFrame, size: int) -> DataFrame:
    """(key, vec) of each column."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for keys, data in zip(f["keys"], f["data"]):
                yield _vectors(np.cumsum(_restored(keys)).view(np.int64), _matrix(data, size).T)

    return parts.select("keys", "data").mapInPandas(run, _VECTORS)


def _matrix(data: bytes, size: int) -> np.ndarray:
    """Components times vectors."""
    return np.frombuffer(data, np.float64).reshape(size, -1)


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """``df``, a stored table whose ``key`` is a monotonically increasing id, with numbers from 0 on instead."""
    each = df.groupBy(F.shiftright(key, 33).alias("_p")).agg(F.count("*").alias("n")).collect()
    n, first = 0, []
    for r in sorted(each, key=lambda r: r["_p"]):
        first.append((r["_p"], n))
        n += r["n"]
    if n >= 1 << 31:
        raise ValueError("over 2^31 rows")
    at = df.sparkSession.createDataFrame(first, "_p long, _first long")
    return df.withColumn("_p", F.shiftright(key, 33)).join(F.broadcast(at), "_p").withColumn(key, F.col("_first") + F.col(key).bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_first")


def _seeds(keys: np.ndarray, seed: int, lo: int, hi: int) -> np.ndarray:
    """Components ``lo`` to ``hi`` of the keys: numbers from 0 to 1 that follow from the key and the seed alone."""
    count = (np.arange(lo + 1, hi + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15)
    x = keys[None, :] + count[:, None]  # a counter from the key, mixed by multiplications and shifts
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x >> np.uint64(11)) / 2.0**53


class _Task:
    """What a group's task of a pass holds: vectors of all rows, and what the rows are given."""

    def __init__(self, how: str, rows: int, size: int, logs: bool, seed: tuple[int, int, int] | None):
        self.how, self.size, self.logs, self.seed = how, size, logs, seed
        whole = -(-rows // BLOCK) * BLOCK
        self.given = np.zeros((size, whole)) if how in ("both", "columns") else None
        self.found = None if how == "columns" else np.zeros((size, whole))
        self.norm, self.known = None, None
        self.whole = whole

    def block(self, at: int, data: bytes | None, norm: bytes | None) -> None:
        here = slice(at * BLOCK, (at + 1) * BLOCK)
        if data is not None:
            self.given[:, here] = _matrix(data, self.size)
        if norm is not None:
            if self.norm is None:
                self.norm = np.zeros(self.whole)
            self.norm[here] = np.frombuffer(norm, np.float64)

    def columns(self, keys: bytes, data: bytes) -> None:
        self.known = np.cumsum(_restored(keys)), _matrix(data, self.size)

    def _of(self, keys: np.ndarray) -> np.ndarray:
        """The columns' vectors; zeros where there is none."""
        if self.seed is not None:
            return _seeds(keys, *self.seed)
        if self.known is None or not len(self.known[0]):
            return np.zeros((self.size, len(keys)))
        known, m = self.known
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return m[:, at] * (known[at] == keys)

    def cells(self, keys: bytes, runs: bytes, scale: bytes, rows: bytes, vals: bytes) -> np.ndarray | None:
        runs, scale, rows = _restored(runs), _restored(scale), np.cumsum(_restored(rows), dtype=np.int64)
        w = _weighed(_restored(vals), self.logs)
        if self.norm is not None:
            w *= self.norm.take(rows, mode="clip")
        start = _starts(runs)
        if self.how == "squares":
            self.found[0] += np.bincount(rows, (w * np.repeat(scale, runs)) ** 2, self.whole)
            return None
        if self.how == "rows":
            z = self._of(np.cumsum(_restored(keys))) * scale
        else:
            z = np.empty((self.size, len(runs)))
            for c in range(self.size):
                x = self.given[c].take(rows, mode="clip")
                x *= w
                z[c] = np.add.reduceat(x, start) * scale
            if self.how == "columns":
                return z
            z *= scale
        for c in range(self.size):
            self.found[c] += np.bincount(rows, w * np.repeat(z[c], runs), self.whole)
        return None


class Sparse:
    """A matrix of entries (row, col: long, w: double), each place once, kept in parts by ranges of the columns' keys."""

    def __init__(self, entries: DataFrame, work: str, tile: int = TILE):
        entries = entries.select("row", "col", "w")
        #: (key, at): the rows' keys and their numbers from 0 on.
        self.index = _numbered(_written(entries.select(F.col("row").alias("key")).distinct().withColumn("at", F.monotonically_increasing_id()), f"{work}/index"), "at")
        parts = max(1, math.ceil(entries.count() / tile))
        dealt = entries.join(self.index, F.col("row") == F.col("key")).select(F.shiftright(F.shiftrightunsigned("col", 32) * parts, 32).cast("int").alias("part"), "at", "col", "w")

        def pack(f: pd.DataFrame) -> pd.DataFrame:
            f = f.assign(col=f["col"].to_numpy().view(np.uint64)).sort_values(["col", "at"])
            keys, runs, rows, n = _coded(f["col"].to_numpy(), f["at"].to_numpy())
            return pd.DataFrame([(f["part"].iloc[0], len(f), keys, runs, _squeezed(np.ones(len(n))), rows, _squeezed(f["w"].to_numpy()))], columns=_names(_CELLS))

        self._take([dealt.groupBy("part").applyInPandas(pack, _CELLS)], work, parts, self.index.count(), tile)

    @classmethod
    def of_cells(cls, cells: Sequence[DataFrame], work: str, parts: int, rows: int, logs: bool) -> Sparse:
        """From tables of packed parts of counts, written one after the other; rows, numbered from 0 on, are made of length one."""
        self = cls.__new__(cls)
        self.index = None
        self._take(cells, work, parts, rows, TILE, logs)
        norms = self.squares()

        def inverse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                m = [np.frombuffer(x, np.float64) for x in f["data"]]
                yield pd.DataFrame({"block": f["block"], "norm": [np.divide(1.0, np.sqrt(x), out=np.zeros(BLOCK), where=x > 0).tobytes() for x in m]})

        self.norms = _written(norms.mapInPandas(inverse, "block int, norm binary"), f"{work}/norms")
        return self

    def _take(self, cells: Sequence[DataFrame], work: str, parts: int, rows: int, tile: int, logs: bool = False) -> None:
        self.work, self.blocks, self.rows, self.logs, self.norms = work, parts, rows, logs, None
        for t in cells:
            self.cells = _written(t, f"{work}/cells")
        size = sum((F.length(c) for c in ("keys", "runs", "scale", "rows", "vals")), F.lit(0))
        n, self.bytes = (x or 0 for x in self.cells.agg(F.sum("n"), F.sum(size)).first())
        self.groups = max(1, min(parts, max(6, math.ceil(math.sqrt(n / tile / 4)))))

    @property
    def entries(self) -> DataFrame:
        """(row, col, w) of each entry, rows by number where they have no keys."""
        logs = self.logs

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for keys, runs, scale, rows, vals in f[["keys", "runs", "scale", "rows", "vals"]].itertuples(index=False):
                    runs = _restored(runs)
                    w = _weighed(_restored(vals), logs) * np.repeat(_restored(scale), runs)
                    yield pd.DataFrame({"row": np.cumsum(_restored(rows), dtype=np.int64), "col": np.repeat(np.cumsum(_restored(keys)).view(np.int64), runs), "w": w})

        found = self.cells.mapInPandas(run, "row long, col long, w double")
        if self.index is not None:
            return found.join(self.index, F.col("row") == F.col("at")).select(F.col("key").alias("row"), "col", "w")
        norms = _by_row(self.norms.withColumnRenamed("norm", "data"), 1)
        return found.join(arrays(norms), F.col("row") == F.col("key")).select("row", "col", (F.col("w") * F.col("vec")[0]).alias("w"))

    def _pass(self, how: str, size: int, rows: DataFrame | None = None, columns: DataFrame | None = None, seed: tuple[int, int, int] | None = None) -> DataFrame:
        """One pass over all parts: blocks of rows' vectors, or parts of columns'."""
        groups, n, logs = self.groups, self.rows, self.logs
        none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
        every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
        own = F.pmod("part", F.lit(groups)).alias("g")
        union = self.cells.select(own, F.lit(2).alias("kind"), F.col("part").alias("at"), "keys", "runs", "scale", "rows", "vals")
        if rows is None and self.norms is not None:
            rows = self.norms.select("block", F.lit(None).cast("binary").alias("data"), "norm")
        elif rows is not None:
            rows = rows.join(self.norms, "block", "full") if self.norms is not None else rows.withColumn("norm", F.lit(None).cast("binary"))
        if rows is not None:
            union = union.unionByName(rows.select(every, F.lit(0).alias("kind"), F.col("block").alias("at"), F.col("data").alias("keys"), F.col("norm").alias("runs"), *none("scale", "rows", "vals")))
        if columns is not None:
            union = union.unionByName(columns.select(own, F.lit(1).alias("kind"), F.col("part").alias("at"), "keys", F.col("data").alias("runs"), *none("scale", "rows", "vals")))
        dealt = union.repartitionById(groups, F.col("g")).sortWithinPartitions("g", F.col("kind") > 0, "at", "kind")

        def blocks(task: _Task | None) -> Iterator[pd.DataFrame]:
            if task is None or task.found is None:
                return
            for k in range(task.found.shape[1] // BLOCK):
                m = task.found[:, k * BLOCK : (k + 1) * BLOCK]
                if m.any():
                    yield pd.DataFrame({"block": [k], "data": [m.tobytes()]})

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            task, group = None, None
            for f in frames:
                for g, kind, at, a, b, c, d, e in f.itertuples(index=False):
                    if g != group:
                        yield from blocks(task)
                        task, group = _Task(how, n, size, logs, seed), g
                    if kind == 0:
                        task.block(at, a, b)
                    elif kind == 1:
                        task.columns(a, b)
                    else:
                        z = task.cells(a, b, c, d, e)
                        task.known = None
                        if z is not None:
                            yield pd.DataFrame({"part": [at], "keys": [a], "data": [z.tobytes()]})
            yield from blocks(task)

        if how == "columns":
            return dealt.mapInPandas(run, _PARTS)

        def add(f: pd.DataFrame) -> pd.DataFrame:
            total = np.frombuffer(f["data"].iloc[0], np.float64).copy()
            for x in f["data"].iloc[1:]:
                total += np.frombuffer(x, np.float64)
            return pd.DataFrame({"block": f["block"].iloc[:1], "data": [total.tobytes()]})

        found = dealt.mapInPandas(run, _BLOCKS)
        return found if groups == 1 else found.groupBy("block").applyInPandas(add, _BLOCKS)

    def squares(self) -> DataFrame:
        """Blocks of the rows' sums of squares."""
        return self._pass("squares", 1)

    def times(self, how: str, size: int, path: str, rows: DataFrame | None = None, columns: DataFrame | None = None, seed: int | None = None) -> DataFrame:
        """A product with vectors of ``size`` components.

        ``rows``: the matrix times ``columns``, or times what follows from the columns' keys and a seed; ``columns``: its
        transpose times ``rows``; ``both``: the matrix times its transpose times ``rows``. Components are taken some at a
        time where they would fill a task or the disk: a task holds two numbers a row and component, and what a pass sends
        beside the matrix is at most half as much again as that one, or ``SENT``.
        """
        most = min(HELD / 16, max(SENT, self.bytes * 1.5) / (16 * self.groups)) / max(1, self.rows)
        step = max(1, min(size, int(most)))
        step = -(-size // -(-size // step)) if size else 1
        if step >= size:
            return self._pass(how, size, rows, columns, None if seed is None else (seed, 0, size))
        found = []
        for lo in range(0, size, step):
            hi = min(size, lo + step)
            cut = lambda t: None if t is None else _picked(t, size, lo, hi)  # noqa: B023, E731
            found.append(_written(self._pass(how, hi - lo, cut(rows), cut(columns), None if seed is None else (seed, lo, hi)), f"{path}-{lo}").withColumn("lo", F.lit(lo)))
        every, first = found[0], "part" if how == "columns" else "block"
        for t in found[1:]:
            every = every.unionByName(t)

        def joined(f: pd.DataFrame) -> pd.DataFrame:
            wide = len(_matrix(f["data"].iloc[0], min(step, size - f["lo"].iloc[0]))[0])
            m = np.zeros((size, wide))
            for lo, data in zip(f["lo"], f["data"]):
                m[lo : lo + step] = _matrix(data, min(step, size - lo))
            return f.iloc[:1].drop(columns="lo").assign(data=[m.tobytes()])

        out = _written(every.groupBy(first).applyInPandas(joined, _PARTS if how == "columns" else _BLOCKS), path)
        for lo in range(0, size, step):
            Files(every.sparkSession, f"{path}-{lo}").delete()
        return out


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _mapped(table: DataFrame, by: Callable[[np.ndarray], np.ndarray], size: int) -> DataFrame:
    """The table of blocks or parts with its data, components times vectors, changed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(data=[np.ascontiguousarray(by(_matrix(x, size))).tobytes() for x in f["data"]])

    return table.mapInPandas(run, table.schema)


def _picked(table: DataFrame, size: int, lo: int, hi: int) -> DataFrame:
    return _mapped(table, lambda m: m[lo:hi], size)


def _turned(table: DataFrame, by: np.ndarray) -> DataFrame:
    """Each vector times a small matrix."""
    return _mapped(table, lambda m: by.T @ m, len(by))


def gram(table: DataFrame, size: int, other: DataFrame | None = None) -> np.ndarray:
    """Products of each two components, or of one and one of the ``other`` table's, summed over all vectors: rank times rank."""
    key = table.columns[0]
    both = table.select("data", F.col("data").alias("d")) if other is None else table.select(key, "data").join(other.select(key, F.col("data").alias("d")), key).select("data", "d")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for f in frames:
            for a, b in zip(f["data"], f["d"]):
                total += _matrix(a, size) @ _matrix(b, size).T
        yield pd.DataFrame({"i": np.arange(size), "row": list(total)})

    cells = both.mapInPandas(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    out = np.zeros((size, size))
    with _frugal(table.sparkSession):
        for r in cells.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
            out[r["i"], r["j"]] = r["x"]
    return out


def _eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and vectors, each with its largest component positive; near-zero ones are left out."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = values > 1e-13 * max(values.max(initial=0.0), 1e-300)
    values, vectors = values[keep], vectors[:, keep]
    if not len(values):
        return values, vectors
    lead = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[lead, np.arange(vectors.shape[1])])


def _singular(matrix: Sparse, rank: int, work: str, more: int, rounds: int, seed: int) -> tuple[np.ndarray, DataFrame, Callable[[], DataFrame]]:
    """(singular values, blocks of rows U S, how to make the parts of columns V).

    Randomised subspace iteration from the side of the rows: with y = A x for random x, each round makes y orthonormal
    and multiplies it by A and its transpose. The last round's y, in the basis that makes the columns' vectors
    orthonormal, is A times those, so that what they span is decomposed exactly without the columns' vectors.
    """
    files, size, rounds = Files(matrix.cells.sparkSession, work), rank + more, max(1, rounds)
    y = _written(matrix.times("rows", size, f"{work}/x", seed=seed), f"{work}/y0")
    files.delete("x")
    by, before = np.eye(size), None
    for k in range(1, rounds + 1):
        values, vectors = _eigen(gram(y, size))
        by = vectors / np.sqrt(values)
        if before is not None:
            files.delete(f"y{k - 2}")
        before, size = y, len(values)
        y = _written(matrix.times("both", size, f"{work}/x{k}", rows=_turned(before, by)), f"{work}/y{k}")
        files.delete(f"x{k}")
    values, vectors = _eigen(gram(_turned(before, by), size, y))
    basis = vectors / np.sqrt(values)
    values, vectors = _eigen(basis.T @ gram(y, size) @ basis)
    values, vectors = values[:rank], vectors[:, :rank]
    turn = basis @ vectors
    return np.sqrt(values), _turned(y, turn), lambda: matrix.times("columns", len(values), f"{work}/v", rows=_turned(before, by @ turn))


def svd(matrix: Sparse, columns: DataFrame, rank: int, work: str, more: int = 10, rounds: int = 4, seed: int = 7) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """(singular values, rows: key and coordinates U S, columns: key and V), of the ``rank`` largest or fewer if there are fewer."""
    values, rows, made = _singular(matrix, rank, work, more, rounds, seed)
    return values, _keyed(matrix, rows, len(values)), _by_column(made(), len(values)).join(columns.select("key"), "key", "left_semi")


def _keyed(matrix: Sparse, blocks: DataFrame, size: int) -> DataFrame:
    """(key, vec) of the rows that the matrix has."""
    found = _by_row(blocks, size)
    if matrix.index is None:
        return found.where(F.col("key") < matrix.rows)
    return found.withColumnRenamed("key", "at").join(matrix.index, "at").select("key", "vec")


def _solve(current: np.ndarray, products: np.ndarray, g: np.ndarray, sweeps: int) -> np.ndarray:
    """Non-negative vectors x, components times vectors, that bring g x near ``products``, component by component from ``current``."""
    x = current.copy()
    for _ in range(sweeps):
        for j in range(len(g)):
            if g[j, j] > 0:
                x[j] = np.maximum(0.0, x[j] + (products[j] - g[j] @ x) / g[j, j])
    return x


def _improved(current: DataFrame, products: DataFrame, g: np.ndarray, sweeps: int) -> DataFrame:
    """The table with better vectors, and ``dot``, their inner products with ``products``."""
    key, size = current.columns[0], len(g)
    both = current.join(products.select(key, F.col("data").alias("p")), key, "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found, dots = [], []
            for x, p in zip(f["data"], f["p"]):
                x = _matrix(x, size)
                p = np.zeros_like(x) if p is None else _matrix(p, size)
                found.append(_solve(x, p, g, sweeps))
                dots.append(float((found[-1] * p).sum()))
            yield f.drop(columns="p").assign(data=[x.tobytes() for x in found], dot=dots)

    kept = [c for c in current.columns if c != "dot"]
    return both.select(*kept, "p").mapInPandas(run, ", ".join(f"{c} {current.schema[c].dataType.simpleString()}" for c in kept) + ", dot double")


def nmf(matrix: Sparse, rows: DataFrame, columns: DataFrame, rank: int, work: str, rounds: int = 15, sweeps: int = 3, tolerance: float = 1e-3, seed: int = 7) -> tuple[DataFrame, DataFrame, list[float]]:
    """(rows: key and weights W, columns: key and weights H, squared error after each round) with the matrix near W H, none negative."""
    w, h, errors = _factors(matrix, rank, work, rounds, sweeps, tolerance, seed)
    return _keyed(matrix, w, rank).join(rows.select("key"), "key", "left_semi"), _by_column(h, rank).join(columns.select("key"), "key", "left_semi"), errors


def _factors(matrix: Sparse, rank: int, work: str, rounds: int, sweeps: int = 3, tolerance: float = 1e-3, seed: int = 7) -> tuple[DataFrame, DataFrame, list[float]]:
    """(blocks of W, parts of H, squared error after each round).

    Coordinate descent: with the one factor held, the vectors of the other are improved one by one from products that
    Spark sums. It starts from numbers that follow from the columns' keys, so a rerun gives the same, and ends after
    ``rounds`` or once a round lowers the error by less than ``tolerance`` of the matrix.
    """
    spark = matrix.cells.sparkSession
    files = Files(spark, work)

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(data=[_seeds(np.cumsum(_restored(x)), seed, 0, rank).tobytes() for x in f["keys"]])

    def zeros(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(data=np.zeros((rank, BLOCK)).tobytes())

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"x": [float(np.frombuffer(x, np.float64).sum()) for x in f["data"]]})

    with _frugal(spark):
        whole = matrix.squares().mapInPandas(total, "x double").agg(F.sum("x")).first()[0] or 0.0
    h = _written(matrix.cells.select("part", "keys").mapInPandas(start, _PARTS), f"{work}/h0")
    w = spark.range(-(-matrix.rows // BLOCK)).select(F.col("id").cast("int").alias("block")).mapInPandas(zeros, _BLOCKS)
    errors: list[float] = []
    held = gram(h, rank)
    for k in range(1, rounds + 1):
        w = _written(_improved(w, matrix.times("rows", rank, f"{work}/p{k}", columns=h), held, sweeps).drop("dot"), f"{work}/w{k}")
        g = gram(w, rank)
        h = _written(_improved(h, matrix.times("columns", rank, f"{work}/q{k}", rows=w), g, sweeps), f"{work}/h{k}")
        held = gram(h, rank)
        for gone in (f"p{k}", f"q{k}", f"w{k - 1}", f"h{k - 1}"):
            files.delete(gone)
        errors.append(max(0.0, whole - 2 * (h.agg(F.sum("dot")).first()[0] or 0.0) + float((g * held).sum())))
        if len(errors) > 1 and errors[-2] - errors[-1] < tolerance * whole:
            break
    return w, h, errors


def _blocks(grams: int, parts: int, lo: int, hi: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Counts of terms of parts ``lo`` to ``hi``, packed by part, of as many texts at a time as hold ``WORDS_HELD`` words, for rows (_key, words: hashes)."""
    least, most = (np.uint64(-(-(p << 32) // parts)) for p in (lo, hi))

    def coded(rows: np.ndarray, words: np.ndarray) -> pd.DataFrame:
        terms, at, gram, n = [], [], words, len(words)
        for k in range(1, grams + 1):  # runs of k words of a text, by a hash of the first k - 1 and the last
            if k > 1:
                gram = (gram[:-1] ^ (gram[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[k - 1 :] * np.uint64(0x9E3779B97F4A7C15)
            own = rows[: n - k + 1] == rows[k - 1 :]
            if hi - lo < parts:
                high = gram >> np.uint64(32)
                own &= (high >= least) & (high < most)
            terms.append(gram[own])
            at.append(rows[: n - k + 1][own])
        terms, at = np.concatenate(terms), np.concatenate(at)
        if not len(terms):
            return pd.DataFrame([], columns=_names(_CODES))
        order = np.argsort(terms, kind="stable")
        terms, at = terms[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (at[1:] != at[:-1])]))
        counts, terms, at = np.diff(new, append=len(terms)), terms[new], at[new]
        cut = np.searchsorted(_part(terms, parts), np.arange(parts + 1, dtype=np.uint64))
        found = []
        for p in np.flatnonzero(cut[1:] > cut[:-1]):
            s = slice(cut[p], cut[p + 1])
            keys, runs, own, _ = _coded(terms[s], at[s])
            found.append((p, at.min(), keys, runs, own, _squeezed(_small(counts[s]))))
        return pd.DataFrame(found, columns=_names(_CODES))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, words, held = [], [], 0
        for f in frames:
            for key, w in zip(f["_key"], f["words"]):
                if len(w):
                    rows.append(np.full(len(w), key, np.int32))
                    words.append(np.asarray(w, np.int64).view(np.uint64))
                    held += len(w)
                if held >= WORDS_HELD:
                    yield coded(np.concatenate(rows), np.concatenate(words))
                    rows, words, held = [], [], 0
        if held:
            yield coded(np.concatenate(rows), np.concatenate(words))

    return run


def _merged(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, rows, counts) of a part's blocks, by key and row."""
    f = f.sort_values("base")
    keys = np.concatenate([np.repeat(np.cumsum(_restored(k)), _restored(r)) for k, r in zip(f["keys"], f["runs"])])
    rows = np.concatenate([np.cumsum(_restored(x), dtype=np.int32) for x in f["rows"]])
    counts = np.concatenate([_restored(x) for x in f["vals"]])
    order = np.lexsort((rows, keys))
    return keys[order], rows[order], counts[order]


def _cell(part: int, keys: np.ndarray, rows: np.ndarray, counts: np.ndarray, scale: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pd.DataFrame:
    if not len(keys):
        return pd.DataFrame([], columns=_names(_CELLS))
    coded, lengths, own, runs = _coded(keys, rows)
    by = scale(keys[_starts(runs)], runs)
    return pd.DataFrame([(part, len(keys), coded, lengths, _squeezed(by), own, _squeezed(_small(counts)))], columns=_names(_CELLS))


class Weights:
    """Term weights of texts: tf-idf, each text's of length one, as a sparse matrix.

    A column's key is a hash of 64 bits of its term; two of 10^8 terms share one with a probability of 0.0003.
    """

    def __init__(self, df: DataFrame, text: str, grams: int = 1, least: int = 1, most: float = 1.0, log_counts: bool = False, pattern: str = WORDS, stop: Sequence[str] = ()):
        """Terms of up to ``grams`` words that stand in ``least`` texts at least and in a share of at most ``most`` of them."""
        self.grams, self.log_counts, self.pattern, self.stop, self.text = grams, log_counts, pattern, [w.lower() for w in stop], text
        self.work = folder(df.sparkSession)
        #: The texts' rows, whose number is ``_key``.
        self.texts = self._stored(df, self.work)
        n, letters = (x or 0 for x in self.texts.agg(F.count("*"), F.sum(F.length(text))).first())
        self.parts = max(1, math.ceil(letters * grams / 6 / TILE))

        def pack(f: pd.DataFrame) -> pd.DataFrame:
            keys, rows, counts = _merged(f)
            runs = np.diff(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), append=len(keys))
            kept = np.repeat((runs >= least) & (runs <= most * n), runs)
            return _cell(f["part"].iloc[0], keys[kept], rows[kept], counts[kept], lambda _, texts: np.log((1.0 + n) / (1.0 + texts)) + 1.0)

        cells = [t.groupBy("part").applyInPandas(pack, _CELLS) for t in self._codes(self.texts)]
        self.matrix = Sparse.of_cells(cells, self.work, self.parts, n, log_counts)

    @staticmethod
    def _stored(df: DataFrame, work: str) -> DataFrame:
        return _numbered(_written(df.withColumn("_key", F.monotonically_increasing_id()), f"{work}/texts", "zstd"), "_key")

    def _words(self) -> Column:
        words = F.regexp_extract_all(F.lower(F.coalesce(F.col(self.text), F.lit(""))), F.lit(f"(?U){self.pattern}"), F.lit(0))
        return F.filter(words, lambda w: ~w.isin(self.stop)) if self.stop else words

    def _codes(self, texts: DataFrame) -> list[DataFrame]:
        """Packed counts, in as many tables as terms have words, so that the disk holds those of one at a time."""
        hashes = texts.select("_key", F.transform(self._words(), lambda w: F.xxhash64(w)).alias("words"))
        n = min(self.grams, self.parts)
        cut = [self.parts * k // n for k in range(n + 1)]
        return [hashes.mapInPandas(_blocks(self.grams, self.parts, lo, hi), _CODES) for lo, hi in zip(cut, cut[1:])]

    def names(self, keys: DataFrame) -> DataFrame:
        """(key, name) of columns that are single words, for few keys: they are looked for in the texts."""
        words = self.texts.select(F.explode(F.array_distinct(self._words())).alias("name")).withColumn("key", F.xxhash64("name"))
        return words.join(F.broadcast(keys.select("key").distinct()), "key").distinct()

    def of(self, df: DataFrame, text: str) -> tuple[DataFrame, Sparse]:
        """Other texts with their ``_key``, and their weights by the terms of this table."""
        work = folder(df.sparkSession)
        texts = self._stored(df, work)

        def pack(f: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            if not len(f) or not len(known):
                return pd.DataFrame([], columns=_names(_CELLS))
            keys, rows, counts = _merged(f)
            terms, scale = np.cumsum(_restored(known["keys"].iloc[0])), _restored(known["scale"].iloc[0])
            at = lambda x: np.minimum(np.searchsorted(terms, x), len(terms) - 1)
            kept = terms[at(keys)] == keys
            return _cell(f["part"].iloc[0], keys[kept], rows[kept], counts[kept], lambda x, _: scale[at(x)])

        known = self.matrix.cells.select("part", "keys", "scale").groupBy("part")
        cells = [t.groupBy("part").cogroup(known).applyInPandas(pack, _CELLS) for t in self._codes(texts.select("_key", F.col(text).alias(self.text)))]
        return texts, Sparse.of_cells(cells, work, self.parts, texts.count(), self.log_counts)


def _unit(c: Column, size: int) -> Column:
    """The vector by its length; zeros where it has none."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(c, lambda x: x / norm)).otherwise(F.array_repeat(F.lit(0.0), size))


class LatentSemantics:
    """Unit vectors of texts from the singular vectors of their weights: words and pairs of words of two texts at least."""

    def __init__(self, df: DataFrame, text: str, size: int = 150, rounds: int = 4):
        self.weights = Weights(df, text, grams=2, least=2, log_counts=True)
        self.values, self._rows, self._made = _singular(self.weights.matrix, size, self.weights.work, 10, rounds, 7)
        self._columns: DataFrame | None = None

    def _joined(self, texts: DataFrame, blocks: DataFrame) -> DataFrame:
        vectors = arrays(_by_row(blocks, len(self.values)))
        found = texts.join(vectors, texts["_key"] == vectors["key"], "left")
        return found.withColumn("vector", _unit(F.col("vec"), len(self.values))).drop("_key", "key", "vec")

    def fitted(self) -> DataFrame:
        """The texts' rows with ``vector``; a text without such terms has zeros."""
        return self._joined(self.weights.texts, self._rows)

    def encode(self, df: DataFrame, text: str) -> DataFrame:
        """Other texts with ``vector``, by the same terms and singular vectors; the first call writes those of the terms."""
        if self._columns is None:
            self._columns = _written(self._made(), folder(df.sparkSession))
        texts, matrix = self.weights.of(df, text)
        return self._joined(texts, matrix.times("rows", len(self.values), f"{matrix.work}/vectors", columns=self._columns))


class Topics:
    """Topics of whole texts as non-negative factors of their weights, numbered from 1."""

    def __init__(self, df: DataFrame, text: str, k: int = 6, stop: Sequence[str] = (), least: int = 5, most: float = 0.5, rounds: int = 15):
        words = [*StopWordsRemover.loadDefaultStopWords("english"), *stop]
        self.size, self.weights = k, Weights(df, text, least=least, most=most, pattern=LETTERS, stop=words)
        self._w, self._h, self.errors = _factors(self.weights.matrix, k, self.weights.work, rounds)

    def assigned(self) -> DataFrame:
        """The texts' rows with ``topic``, the first one of the largest weight, and ``weight``; null where no weight is positive."""
        most = F.array_max("vec")
        known = arrays(_by_row(self._w, self.size)).select("key", F.when(most > 0, F.array_position("vec", most).cast("int")).alias("topic"), F.when(most > 0, most).alias("weight"))
        return self.weights.texts.join(known, F.col("_key") == F.col("key"), "left").drop("_key", "key")

    def words(self, n: int = 8) -> DataFrame:
        """(topic, place, word, weight): the n words of the largest weight of each topic, ties by word; n rows a task and topic are kept."""
        each = arrays(_by_column(self._h, self.size)).select("key", F.posexplode("vec").alias("topic", "weight")).where("weight > 0")
        heavy = Window.partitionBy("topic").orderBy(F.desc("weight"))
        first = each.withColumn("r", F.row_number().over(heavy)).where(F.col("r") <= n).groupBy("topic").agg(F.min("weight").alias("least"))
        each = _written(each.join(F.broadcast(first), "topic").where("weight >= least").drop("least"), folder(each.sparkSession))  # with all ties of the last
        named = each.join(self.weights.names(each), "key").select("name", "topic", "weight")
        place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "name"))
        return named.withColumn("place", place).where(F.col("place") <= n).select((F.col("topic") + 1).alias("topic"), "place", F.col("name").alias("word"), "weight")
