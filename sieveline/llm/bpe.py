"""Byte-level BPE: encoding by a contiguous rank array, and decoding.

A word's parts lie side by side: one list holds the boundaries, one the rank of merging each part with the
next. The least rank is searched by scanning, its boundary is deleted and the ranks on both sides are looked
up anew. Words of over ``LONG`` bytes keep their candidates in a heap instead, with the same result.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, held_in_worker

LONG = 128
#: Entries of a worker's memories of encoded pieces and of chunks between spaces; each is emptied when full,
#: which changes no result. Pieces cost more to encode than chunks to split, so more of them are kept.
MEMORY, CHUNK_MEMORY = 600_000, 300_000
#: The split pattern that byte-level vocabularies of this family are made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE, _LOW = 1 << 60, (1 << 32) - 1


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable in Latin-1, else from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Overlap(Exception):
    """White space meets a cut between chunks, so the chunk cannot be encoded by itself."""


class _Chunks(dict):
    """Chunk between two single spaces -> ids of the chunk with the space before it."""

    def __init__(self, bpe: BytePairs):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Overlap
        if len(self) >= CHUNK_MEMORY:
            self.clear()
        ids = self[chunk] = self.bpe.pieces(" " + chunk)
        return ids


class BytePairs:
    """A byte-level BPE vocabulary in the JSON format of public tokenizer files."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        alphabet, model = byte_alphabet(), spec["model"]
        raw = lambda s: bytes(alphabet[c] for c in s)
        ids = {raw(k): v for k, v in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        tokens = {v: k for k, v in ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.tokens = [tokens.get(k, b"") for k in range(max(tokens) + 1)]
        self.first = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], int] = {}  # rank in the high bits, id of the merged part in the low 32
        for rank, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[ids[a], ids[b]] = rank << 32 | ids[a + b]
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self)

    def word(self, data: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.first[b] for b in data]
        if len(parts) > LONG:
            return self._long_word(parts)
        get, none = self.merges.get, _NONE
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at] = best & _LOW
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), none)
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), none)
        return parts

    def _long_word(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m >> 32, k, m & _LOW, parts[k], parts[k + 1]) for k in range(n - 1) if (m := get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            right = after[k]
            if right < 0 or parts[k] != a or parts[right] != b:
                continue
            parts[k], parts[right] = new, -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (m := get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (m >> 32, x, m & _LOW, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def pieces(self, text: str) -> bytes:
        """Ids (32-bit, little-endian) of a text without special tokens."""
        words, out = self.words, []
        for piece in self.find(text):
            got = words.get(piece)
            if got is None:
                got = array("I", self.word(piece.encode("utf-8", "replace"))).tobytes()
                if len(piece) < 64:
                    if len(words) >= MEMORY:
                        words.clear()
                    words[piece] = got
            out.append(got)
        return b"".join(out)

    def _ordinary(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self.pieces(first) + b"".join(map(self.chunks.__getitem__, rest))
            except _Overlap:
                pass
        return self.pieces(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; the strings of special tokens become these tokens."""
        text = text or ""
        if self.cut is None or not (found := list(self.cut.finditer(text))):
            return self._ordinary(text)
        out, at = [], 0
        for m in found:
            out += [self._ordinary(text[at : m.start()]), np.array([self.special[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._ordinary(text[at:])])

    def decode(self, ids) -> str:
        """Text of ids; ids outside the vocabulary give nothing, bytes that are no UTF-8 give U+FFFD."""
        tokens = self.tokens
        if len(ids) and (min(ids) < 0 or max(ids) >= len(tokens)):
            ids = [i for i in ids if 0 <= i < len(tokens)]
        return b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")


def _load(spec: str) -> BytePairs:
    return held_in_worker("byte pairs", hash(spec), lambda: BytePairs(spec))


def encode_texts(rows: DataFrame, spec: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``rows`` with the ids (array of int) of each whole text instead of the text column.

    ``spec`` is the content of a vocabulary file. Null and empty texts have no ids; a column named as
    ``ids_col`` is replaced; repeated rows stay, an empty table gives an empty result. With ``decoded_col`` the
    text decoded from these ids follows, as ``decode_ids`` gives it.
    """
    others = [c for c in rows.columns if c not in (text_col, ids_col, decoded_col)]
    shared = rows.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(shared.value)
        for b in (b.slice(at, 1000) for b in batches for at in range(0, len(b), 1000)):
            got = [bpe.encode(t) for t in b.column(len(others)).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in got)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(got), "<i4")))
            own, names = [*(b.column(k) for k in range(len(others))), ids], [*others, ids_col]
            if decoded_col:
                own.append(pa.array([bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in got], pa.string()))
                names.append(decoded_col)
            yield pa.RecordBatch.from_arrays(own, names=names)

    base = rows.select(*others, F.col(text_col).cast("string").alias(text_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{schema}{', ' if schema else ''}`{ids_col}` array<int>" + (f", `{decoded_col}` string" if decoded_col else ""))


def decode_ids(rows: DataFrame, spec: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of each row's ids as ``out``; null ids give ''."""
    others = [c for c in rows.columns if c != out]
    shared = rows.sparkSession.sparkContext.broadcast(spec)
    at = others.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(shared.value)
        for b in (b.slice(k, 1000) for b in batches for k in range(0, len(b), 1000)):
            ids = b.column(at)
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            texts = [bpe.decode(flat[s:e].tolist()) for s, e in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(others))), pa.array(texts, pa.string())], names=[*others, out])

    base = rows.select(*others).withColumn(ids_col, F.coalesce(ids_col, F.array().cast("array<int>")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{schema}, `{out}` string")


def vocabulary(name: str) -> str:
    """Content of a public vocabulary file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def digests(rows: DataFrame, spec: str, text_col: str = "text") -> DataFrame:
    """``rows`` without the text, with n_tokens, ids_sha256 and decoded_sha256, which replace columns of these names.

    All other columns stay, whatever their names. Null and empty texts have no ids; very long texts are encoded
    whole; repeated rows stay, an empty table gives an empty result.
    """
    ids, decoded = free_names(rows, "ids", "decoded")
    coded = encode_texts(rows, spec, text_col, ids, decoded_col=decoded)
    return coded.withColumns(
        {
            "n_tokens": F.size(ids).cast("long"),
            "ids_sha256": F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")), 256),
            "decoded_sha256": F.sha2(F.encode(decoded, "UTF-8"), 256),
        }
    ).drop(ids, decoded)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, vocabulary("byte_bpe_50k.json"))
