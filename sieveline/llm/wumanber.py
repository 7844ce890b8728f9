"""Benchmark decontamination by Wu-Manber search: many word windows looked for in every text at once.

Symbols are words, blocks are two consecutive words. A table by block hash says how far the search may move on without
missing a window's end; where it says zero, the bucket of that block, told apart by a hash of the window's first block,
holds the windows to compare, word by word, and what agrees is compared as text. Texts are searched many places
at a time: a batch's words are cut into lanes, and all lanes move on in step, each by its own shift.

Windows come in blocks of bounded size; each block is broadcast and goes once over all texts, so a benchmark of any
size is searched whole. Usually there is one block, and the search is a map without any shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_in_worker

WINDOW = 10
#: Pairs of window and item that are searched for at a time.
BLOCK_PAIRS = 200_000
#: Words of a lane, and bytes of text that a task works on at a time (a longer text alone).
LANE, SLICE = 256, 1 << 22
#: Bytes whose hash powers are kept; a longer run of words is hashed in pieces.
_PIECE = 1 << 20
_BASE, _BACK = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_MIX = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _letters() -> np.ndarray:
    """A byte's lower case where it belongs to a word (digits, ASCII letters, all of non-ASCII characters), else 0."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for low, high in ((0, 48), (58, 65), (91, 97), (123, 128)):
        table[low:high] = 0
    return table


_LETTERS = _letters()
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(max(n, _PIECE) - 1, x, np.uint64))) for x in (_BASE, _BACK)]
    return _POWERS[0], _POWERS[1]


def _runs(on: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none of which goes over an edge."""
    edge = np.zeros(len(on) + 1, bool)
    edge[edges] = True
    before, after = np.zeros(len(on), bool), np.zeros(len(on), bool)
    before[1:], after[:-1] = on[:-1], on[1:]
    return np.flatnonzero(on & (~before | edge[:-1])), np.flatnonzero(on & (~after | edge[1:])) + 1


class Words:
    """Words of concatenated texts: their places, 64-bit hashes and text, and the lower-cased bytes between zeros."""

    def __init__(self, data: np.ndarray, edges: np.ndarray):
        """``data``: bytes of all texts; ``edges``: where each text starts, and the end."""
        self.low = _LETTERS[data]
        self.start, self.stop = _runs(self.low > 0, edges)
        #: The first word of each text, and the number of all words.
        self.first = np.searchsorted(self.start, edges)
        self.hash = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            s = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.stop, s + _PIECE, "right")))
            up, back = _powers(int(self.stop[to - 1] - s))
            sums = np.zeros(self.stop[to - 1] - s + 1, np.uint64)
            np.cumsum(self.low[s : self.stop[to - 1]].astype(np.uint64) * up[: len(sums) - 1], out=sums[1:])
            self.hash[at:to] = (sums[self.stop[at:to] - s] - sums[self.start[at:to] - s]) * back[self.start[at:to] - s]
            at = to

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1, joined by spaces."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.stop[a:b].tolist()))


class Search:
    """Tables for windows of one number of words."""

    def __init__(self, windows: list[bytes], size: int):
        self.windows, self.size, self.block = windows, size, min(2, size)
        joined = np.frombuffer(b" ".join(windows), np.uint8)
        words = Words(joined, np.array([0, len(joined)])).hash.reshape(len(windows), size)
        self.bits = int(np.clip(np.ceil(np.log2(8 * words.size)), 12, 24))
        self.shift = np.full(1 << self.bits, size - self.block + 1, np.uint8)
        for end in range(self.block - 1, size):
            np.minimum.at(self.shift, self.slot(words[:, end - self.block + 1], words[:, end]), size - 1 - end)
        keys = self.key(words[:, -self.block], words[:, -1], words[:, 0], words[:, self.block - 1])
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.words = keys[self.order], words[self.order]

    def _mixed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * _MIX[0]
        return ((x ^ (x >> np.uint64(29))) + b) * _MIX[1]

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self._mixed(a, b) >> np.uint64(64 - self.bits)).astype(np.int64)

    def key(self, a, b, c, d) -> np.ndarray:
        """A window's bucket by its last block (a, b), and its first block (c, d) within that."""
        return self.slot(a, b).astype(np.uint64) << np.uint64(32) | self._mixed(c, d) >> np.uint64(32)

    def ends(self, words: Words) -> np.ndarray:
        """Places of words at which a window may end: those that no shift skips."""
        h, found = words.hash, []
        place = np.arange(self.size - 1, len(h), LANE)
        stop = np.minimum(place + LANE, len(h))
        while len(place):
            shift = self.shift[self.slot(h[place - self.block + 1], h[place])]
            found.append(place[shift == 0])
            place = place + np.maximum(shift, 1)
            left = place < stop
            place, stop = place[left], stop[left]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def occurrences(self, words: Words, text_of: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
        """(first word, number of the window) of each occurrence within one text."""
        end = self.ends(words)
        start = end - self.size + 1
        same = text_of[start] == text_of[end]
        start, end, h = start[same], end[same], words.hash
        keys = self.key(h[end - self.block + 1], h[end], h[start], h[start + self.block - 1])
        low = np.searchsorted(self.keys, keys, "left")
        sizes = np.searchsorted(self.keys, keys, "right") - low
        start, low, sizes = start[sizes > 0], low[sizes > 0], sizes[sizes > 0]
        upto, at = np.cumsum(sizes), 0
        while at < len(sizes):  # so many comparisons at a time, whatever the bucket's size
            base = upto[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(upto, base + most, "right")))
            of = np.repeat(np.arange(at, to), sizes[at:to])
            window = low[of] + np.arange(len(of)) - (upto[of] - sizes[of] - base)
            equal = np.ones(len(of), bool)
            for k in range(self.size):
                equal[equal] = h[start[of[equal]] + k] == self.words[window[equal], k]
            for s, w in zip(start[of[equal]].tolist(), self.order[window[equal]].tolist()):
                if words.text(s, s + self.size) == self.windows[w]:
                    yield s, w
            at = to


class Block:
    """Searches for a block of (window, item) pairs, by the number of words."""

    def __init__(self, windows: list[bytes], items: list[str]):
        by_size: dict[int, dict[bytes, list[str]]] = {}
        for w, i in zip(windows, items):
            by_size.setdefault(w.count(b" ") + 1, {}).setdefault(w, []).append(i)
        self.parts = [(Search(list(found), size), list(found.values())) for size, found in sorted(by_size.items())]

    def hits(self, words: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are hit, and the items found in each text."""
        texts = len(words.first) - 1
        text_of = np.repeat(np.arange(texts), np.diff(words.first))
        change, items = np.zeros(len(words.hash) + 1, np.int64), [set() for _ in range(texts)]
        for search, of in self.parts:
            for s, w in search.occurrences(words, text_of):
                change[s] += 1
                change[s + search.size] -= 1
                items[text_of[s]].update(of[w])
        return np.cumsum(change[:-1]) > 0, items


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the places where its rows start, and the end; null is empty."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data, ends


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE bytes, one row at least."""
    at, n = 0, len(ends) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        yield at, min(to, n)
        at = to


def windows_of(bench: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item string, window binary): ``window`` consecutive words; all words of an item of fewer, but not none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _texts(batch.column(1))
            for k, item in enumerate(batch.column(0).to_pylist()):
                words = Words(data[ends[k] : ends[k + 1]], np.array([0, ends[k + 1] - ends[k]]))
                n = len(words.hash)
                last = max(n - window, 0) + 1 if n else 0
                for at in range(0, last, 20_000):
                    found = [words.text(s, min(s + window, n)) for s in range(at, min(at + 20_000, last))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], names=["item", "window"])

    rows = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return rows.mapInArrow(run, "item string, window binary").distinct()


_FOUND = "n_words long, spans array<struct<a:long,b:long>>, items array<string>"


def _search(rows: DataFrame, windows: list[bytes], items: list[str]) -> DataFrame:
    """``rows`` (one or more key columns, then text) with the words of each text, the spans of hit words and the items found."""
    shared, name = rows.sparkSession.sparkContext.broadcast((windows, items)), uuid.uuid4().hex
    keys = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held_in_worker("wumanber", name, lambda: Block(*shared.value))
        for batch in batches:
            data, ends = _texts(batch.column(len(keys)))
            for at, to in _slices(ends):
                words = Words(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
                hit, found = block.hits(words)
                a, b = _runs(hit, words.first)
                text_of = np.searchsorted(words.first, a, "right") - 1
                base = words.first[text_of]
                cut = np.searchsorted(text_of, np.arange(to - at + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(a - base), pa.array(b - base)], names=["a", "b"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(at, to - at) for k in range(len(keys))), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(cut), pairs), pa.array([sorted(x) for x in found], pa.list_(pa.string()))],
                    names=[*keys, "n_words", "spans", "items"],
                )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, schema + _FOUND)


def contaminated_words(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(id, n_words, spans, items) per document: its words, the spans [a, b) of words hit, and the items whose windows occur.

    Words are runs of ASCII letters, lower-cased, digits and non-ASCII characters. A null or empty text has no words
    and hits nothing; texts of any length are searched whole, words of any length count. Repeated documents and ids
    have a row each; a null id stays null. Other columns are not read, so their names do not matter. Items of one id,
    as text, are one item; all without an id are the item ''. An item without words, or an empty benchmark, is found
    nowhere; an empty table of documents gives an empty one. Spans are sorted and disjoint, as are the items.
    """
    scratch = Scratch(docs.sparkSession, "wumanber")
    pairs = scratch.write(windows_of(bench, window, item_col, item_text), "windows")
    blocks = max(1, -(-pairs.count() // block_pairs))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part = lambda k: pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k).toArrow()
    if blocks == 1:
        t = part(0)
        return _search(rows, t["window"].to_pylist(), t["item"].to_pylist())
    rows = scratch.write(rows.select("id", F.monotonically_increasing_id().alias("row"), "text"), "texts")
    found = None
    for k in range(blocks):
        t = part(k)
        one = scratch.write(_search(rows, t["window"].to_pylist(), t["item"].to_pylist()), f"found{k}")
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return merged.select("id", "n_words", _union(F.array_sort("spans")).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def _union(spans: Column) -> Column:
    """Sorted spans joined where they overlap or touch."""

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (x["a"] <= F.try_element_at(done, F.lit(-1))["b"]), wider).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast("array<struct<a:bigint,b:bigint>>"), step)


def op11_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contaminated_words(docs, bench)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return found.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_SQL_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(w[p : p + least(len(w), {WINDOW}) - 1], ' ') AS win
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM v),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
g AS (SELECT r, size, p, array_to_string(w[p : p + size - 1], ' ') AS win
      FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, s WHERE len(w) >= size)),
o AS (SELECT r, p, size, item FROM g JOIN v USING (size, win)),
h AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT r, p, size FROM o)) GROUP BY r),
f AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n, 0) AS BIGINT) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN f USING (r)
"""
