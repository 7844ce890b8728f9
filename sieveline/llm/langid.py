"""Language identification by rank-order profiles of character n-grams.

A profile is the ranked list of the most frequent n-grams of one to three characters. A document's own ranked
list is compared to every language's by the out-of-place distance: the sum of rank differences, where an n-gram
that the profile lacks costs the profile's length. The nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, held_out

PROFILE = 400
SAMPLE = 3000
LANGUAGES = 1000

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the text's n-grams, n from 1 to 3, in lower case; runs of non-letters are one '_'.

    A code holds up to three code points, 21 bits each. Without a letter both arrays are empty.
    """
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.where(letter, c, np.uint32(95)).astype(np.int64)
    c = np.concatenate([[95], c, [95]])
    gap = c == 95
    c = c[~(gap & np.concatenate([[False], gap[:-1]]))]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.unique(np.concatenate([c[c != 95], two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent codes, most frequent first, ties by code."""
    if len(codes) > most:
        cut = np.partition(counts, len(counts) - most)[len(counts) - most]
        at = np.flatnonzero(counts >= cut)
        codes, counts = codes[at], counts[at]
    return codes[np.lexsort((codes, -counts))][:most]


def learn_profiles(rows: DataFrame, id_col: str, text_col: str, lang_col: str, length: int = PROFILE, sample: int = SAMPLE, most: int = LANGUAGES) -> dict[str, np.ndarray]:
    """Profile of each language in ``rows``, from about ``sample`` of its documents, whole. Null languages teach nothing.

    Only the ``most`` most frequent values of the language column are learned, so that a dirty column stays bounded.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                parts = [ngrams(t) for t in own]
                codes, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([y for _, y in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

    chosen = bounded_sample(rows, "lang", "id", sample, 5, most).select("lang", "text")
    total = chosen.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = total.withColumn("r", F.row_number().over(first)).where(F.col("r") <= length).orderBy("lang", "r").collect()
    profiles: dict[str, list[int]] = {}
    for row in top:
        profiles.setdefault(row["lang"], []).append(row["code"])
    return {k: np.array(v, np.int64) for k, v in profiles.items()}


class Profiles:
    """Profiles sorted by code, ready to look up."""

    def __init__(self, profiles: dict[str, np.ndarray], length: int):
        self.length, self.names = length, sorted(profiles)
        self.sorted = []
        for name in self.names:
            order = np.argsort(profiles[name])
            self.sorted.append((profiles[name][order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = ranked(*ngrams(text), self.length)
        if not len(codes) or not self.names:
            return "und", 0.0
        own, distances = np.arange(len(codes)), []
        for known, ranks in self.sorted:
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            distances.append(np.where(known[at] == codes, np.abs(ranks[at] - own), self.length).sum())
        best = int(np.argmin(distances))
        return self.names[best], 1.0 - float(distances[best]) / (self.length * len(codes))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", length: int = PROFILE) -> DataFrame:
    """(id, lang_pred, score) of each row; score is 1 less the mean cost of an n-gram by the highest possible.

    Very long texts count whole. Null texts and texts without a letter are ``und`` with score 0, as is everything when no language is known.
    Equal distances go to the language first by name. Repeated rows stay, an empty table gives an empty result;
    other columns are not looked at.
    """
    known = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [known.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn_profiles(docs.where(~held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    found = identify(docs, profiles)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
