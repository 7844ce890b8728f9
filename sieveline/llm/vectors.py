"""Vector tables as the similarity operators read them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_keys(rows: DataFrame, vec_col: str, others: list[str]) -> DataFrame:
    """``others`` and key: the vector's bytes as 64-bit floats, null where it cannot be compared.

    Null vectors, vectors with null or non-finite components and zero vectors have no key. Equal vectors have equal
    keys (minus zero counts as zero).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(others))
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False) + 0.0  # null is NaN
            of = lambda what: np.diff(np.concatenate([[0], np.cumsum(what)])[ends])
            usable = lists.is_valid().to_numpy(zero_copy_only=False) & (of(~np.isfinite(flat)) == 0) & (of(flat != 0) > 0)
            raw = flat.tobytes()
            keys = [raw[8 * s : 8 * e] if ok else None for s, e, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), usable.tolist())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(others))), pa.array(keys, pa.binary())], names=[*others, "key"])

    base = rows.select(*others, F.col(vec_col).cast("array<double>").alias("_vec"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{schema}key binary")


def matrix(keys: list[bytes]) -> np.ndarray:
    """Rows of equal length from keys."""
    return np.frombuffer(b"".join(keys), np.float64).reshape(len(keys), -1)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows divided by their length, safe for very large and very small components."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def common_length(keys: DataFrame) -> int:
    """The most frequent key length; 0 for no keys. Vectors of other lengths take no part in a comparison."""
    row = keys.where("key IS NOT NULL").groupBy(F.length("key").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row["n"] if row else 0
