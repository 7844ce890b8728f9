"""Token ids as files of independent blocks, coded by a static range asymmetric numeral system.

One frequency table, counted over all ids, serves every block. A block holds whole documents, or a piece of a very
long one; its ids are dealt over 32 interleaved lanes, each a 32-bit state that gives off 16-bit words. Every
``CHECK`` steps the block keeps a checkpoint (all states and the place in the word stream), so decoding can start at
any of them, and the checkpoints of many blocks are decoded side by side. A CRC-32 guards all that a block holds.

Files are two Parquet tables, so that Spark's readers, writers and committers handle them: the blocks, one row each,
and the model (version, id type, end id, frequency table), one row; any session can read them back.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, held_in_worker

LANES, CHECK, BITS = 32, 512, 16
LOW = 1 << 16
BLOCK = 1 << 16
#: Ids of a range partition of the files, about, and the most partitions; tasks stream, so a partition may be of any size.
IDS_A_PART, MOST_PARTS = 1 << 22, 50_000
VERSION = 2
BLOCK_SCHEMA = "part long, seq int, doc_ids array<long>, n_ids array<long>, start_in_part long, piece_at long, words binary, states binary, offsets array<int>, crc long"
MODEL_SCHEMA = "version int, id_type string, end_id int, lanes int, check int, bits int, freq binary, crc long"


def frequency_table(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to sum to 2^bits, at least 1 where a count is positive."""
    used = np.flatnonzero(counts)
    if not len(used):
        return np.zeros(len(counts), np.int64)
    room = 1 << bits
    if len(used) > room:
        raise ValueError(f"{len(used)} symbols need more than {bits} bits")
    freq = np.zeros(len(counts), np.int64)
    freq[used] = np.maximum(1, np.floor(counts[used] / counts.sum() * room)).astype(np.int64)
    over = int(freq.sum()) - room
    order = used[np.argsort(-freq[used], kind="stable")]
    while over > 0:  # take from the largest, never below 1
        give = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * over // max(1, int(freq[order].sum()))))
        give = np.where(np.cumsum(give) <= over, give, np.maximum(0, over - (np.cumsum(give) - give)))
        freq[order] -= give
        over -= int(give.sum())
    freq[order[0]] -= over
    return freq


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, states at each checkpoint, places of the checkpoints in words) of each block of ids."""
        if len(blocks) > 1 and max(map(len, blocks)) > 2 * BLOCK:  # a very long one must not widen the others
            return [self.encode([b])[0] for b in blocks]
        steps = [-(-len(b) // LANES) for b in blocks]
        top, n = max(steps, default=0), len(blocks)
        ids, live = np.zeros((top, n, LANES), np.uint32), np.zeros((top, n, LANES), bool)
        for k, b in enumerate(blocks):
            whole = np.zeros(steps[k] * LANES, np.uint32)
            whole[: len(b)] = b
            ids[: steps[k], k] = whole.reshape(-1, LANES)
            live[: steps[k], k] = (np.arange(steps[k] * LANES) < len(b)).reshape(-1, LANES)
        state = np.full((n, LANES), LOW, np.uint64)
        words, gave = np.zeros((top, n, LANES), np.uint16), np.zeros((top, n, LANES), bool)
        kept = np.zeros((-(-top // CHECK), n, LANES), np.uint32)
        for t in range(top - 1, -1, -1):
            f, s, on = self.freq[ids[t]], self.start[ids[t]], live[t]
            give = on & (state >= f << np.uint64(32 - BITS))
            words[t] = np.where(give, state & np.uint64(LOW - 1), 0)
            gave[t] = give
            state = np.where(give, state >> np.uint64(16), state)
            f1 = np.maximum(f, np.uint64(1))
            state = np.where(on, ((state // f1) << np.uint64(BITS)) + state % f1 + s, state)
            if t % CHECK == 0:
                kept[t // CHECK] = state
        out = []
        for k in range(n):
            marks = range(0, steps[k], CHECK)
            places = [0, *np.cumsum([int(gave[t : t + CHECK, k].sum()) for t in marks]).tolist()][: len(marks)]
            out.append((words[: steps[k], k][gave[: steps[k], k]], kept[: len(marks), k], np.array(places, np.int32)))
        return out

    def decode(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of each block, from (words, states, places, number of ids); all checkpoints run side by side."""
        if not blocks:
            return []
        base = np.cumsum([0, *(len(w) for w, *_ in blocks)])
        words = np.concatenate([*(w for w, *_ in blocks), np.zeros(LANES + 1, np.uint16)]).astype(np.uint64)
        if not (total := sum(len(p) for _, _, p, _ in blocks)):
            return [np.empty(0, np.uint32) for _ in blocks]
        state = np.concatenate([s.reshape(-1, LANES) for _, s, _, _ in blocks]).astype(np.uint64)
        place = np.concatenate([p.astype(np.int64) + base[k] for k, (_, _, p, _) in enumerate(blocks)])
        count = np.concatenate([np.clip(n - np.arange(len(p)) * CHECK * LANES, 0, CHECK * LANES) for _, _, p, n in blocks]).astype(np.int64)
        out = np.zeros((CHECK, total, LANES), np.uint32)
        lane = np.arange(LANES)
        for t in range(min(CHECK, -(-int(count.max()) // LANES))):
            on = t * LANES + lane < count[:, None]
            slot = state & np.uint64((1 << BITS) - 1)
            ids = self.symbol[slot.astype(np.int64)]
            out[t] = ids
            state = np.where(on, self.freq[ids] * (state >> np.uint64(BITS)) + slot - self.start[ids], state)
            need = on & (state < LOW)
            at = place[:, None] + np.cumsum(need, axis=1) - need
            state = np.where(need, (state << np.uint64(16)) | words[np.minimum(at, len(words) - 1)], state)
            place = place + need.sum(axis=1)
        flat, got, at = out.transpose(1, 0, 2).reshape(total, -1), [], 0
        for _, _, p, n in blocks:
            got.append(flat[at : at + len(p)].reshape(-1)[:n])
            at += len(p)
        return got


#: Entries of a worker's memory of encoded chunks; it is emptied when full, which changes no result.
MEMORY = 1_300_000
#: Latin-1 bytes as the split wants them: lower case, a line break as a space; letters; ASCII marks.
_LOWER = bytes(32 if k == 10 else ord(chr(k).lower()) for k in range(256))
_LETTER = np.array([chr(k).isalpha() and (k < 128 or k >= 192) for k in range(256)])
_MARK = np.array([33 <= k <= 126 and not chr(k).isalnum() for k in range(256)])


def _latin(text: str) -> bytes | None:
    """The text in Latin-1; null where it is not Latin-1 or may hold a special token."""
    if "<|" in text:
        return None
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


class Chunks:
    """A tokenizer of the tokenizers library whose vocabulary ignores case and drops white space, with a memory.

    Its words never reach over white space, so a text is encoded chunk by chunk between spaces, each distinct
    chunk once by the library. In Latin-1 texts, where lower case commutes with normal forms, chunks are also
    freed of case and cut where a mark follows a letter, as a word ends there in any case.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib, self.known, self.kind = Tokenizer.from_str(spec), {}, id_type(spec)
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[v for k, v in vocab.items() if k.endswith("</w>")]] = True

    @staticmethod
    def split(texts: list[str]) -> list[list[str]]:
        """Chunks of each text. Latin-1 texts are prepared all at once, as bytes."""
        raw = [_latin(t) for t in texts]
        latin = [r for r in raw if r is not None]
        data = np.frombuffer(b" ".join(latin).translate(_LOWER), np.uint8)
        cut = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
        whole = np.insert(data, cut, 32).tobytes().decode("latin-1")
        sizes = np.array([len(r) for r in latin], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        place = lambda at: iter((at + np.searchsorted(cut, at, "right")).tolist())
        first, last = place(ends - sizes), place(ends)
        return [t.split(" ") if r is None else whole[next(first) : next(last)].split(" ") for t, r in zip(texts, raw)]

    def encode(self, texts: list[str | None], tail: bytes = b"") -> list[bytes]:
        """Little-endian ids of each text, as wide as the vocabulary needs them, with ``tail`` behind each."""
        out: list[bytes] = []
        for at in range(0, len(texts), 200):
            split = self.split([t or "" for t in texts[at : at + 200]])
            if len(self.known) > MEMORY:
                self.known.clear()
            get = self.known.get
            found = [list(map(get, s)) for s in split]
            if gaps := [k for k, f in enumerate(found) if None in f]:
                self._learn({w for k in gaps for w, ids in zip(split[k], found[k]) if ids is None})
                for k in gaps:
                    found[k] = list(map(get, split[k]))
            out += [b"".join(f) + tail for f in found]
        return out

    def _learn(self, new: set[str]) -> None:
        # a Latin-1 word of letters is one word of the vocabulary, so many can be encoded as one text
        plain = [w for w in new if w.isalpha() and ord(max(w)) < 256]
        some = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        for words, got in zip(some, self._library([" ".join(s) for s in some])):
            stops = (np.flatnonzero(self.ends[got]) + 1).tolist()
            if len(stops) == len(words):
                for w, start, stop in zip(words, [0, *stops], stops):
                    self.known[w] = got[start:stop].tobytes()
        rest = [w for w in new if w not in self.known]
        for k in range(0, len(rest), 5000):
            for chunk, got in zip(rest[k : k + 5000], self._library(rest[k : k + 5000])):
                self.known[chunk] = got.tobytes()

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]


def _load(spec: str) -> Chunks:
    return held_in_worker("chunks", hash(spec), lambda: Chunks(spec))


def vocabulary_size(spec: str) -> int:
    j = json.loads(spec)
    return 1 + max([0, *j["model"]["vocab"].values(), *(t["id"] for t in j.get("added_tokens", []))])


def id_type(spec: str) -> str:
    """Little-endian ids of 2 bytes where the vocabulary allows it, else of 4."""
    return "<u2" if vocabulary_size(spec) <= 1 << 16 else "<u4"


def token_table(docs: DataFrame, spec: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, counts): the ids of each whole text as bytes; counts (64-bit, by id) only in a last row of each task."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    kind, size = id_type(spec), vocabulary_size(spec)
    tail = b"" if end_id is None else np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counts = _load(shared.value), np.zeros(size, np.int64)
        rows = lambda *columns: pa.RecordBatch.from_arrays(list(columns), names=["id", "ids", "counts"])
        for b in (b.slice(at, 1000) for b in batches for at in range(0, len(b), 1000)):
            ids = coder.encode(b.column(1).to_pylist(), tail)
            counts += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=size)
            yield rows(b.column(0), pa.array(ids, pa.binary()), pa.nulls(len(b), pa.binary()))
        if counts.any():
            yield rows(pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary()))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, ids binary, counts binary")


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """Count of each id over a ``token_table``, summed by task and then by id: at most ``size`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            for counts in b.column(0).to_pylist():
                n += np.frombuffer(counts, np.int64)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["token", "n"])

    out = np.zeros(size, np.int64)
    summed = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "token long, n long")
    for r in summed.groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[r["token"]] = r["n"]
    return out


def _checksum(r: dict) -> int:
    """CRC-32 of everything that a block's row holds."""
    ids = r["doc_ids"]
    head = np.array([r["part"], r["seq"], r["start_in_part"], -1 if r["piece_at"] is None else r["piece_at"], len(ids), *r["n_ids"], *r["offsets"]], "<i8")
    names = np.array([[x is None, x or 0] for x in ids], "<i8")
    crc = 0
    for part in (head.tobytes(), names.tobytes(), r["words"], r["states"]):
        crc = zlib.crc32(part, crc)
    return crc


def write_blocks(tokens: DataFrame, freq: np.ndarray, kind: str, partitions: int) -> DataFrame:
    """Blocks (BLOCK_SCHEMA) of ``tokens`` in ascending id order; ``part`` numbers the ranges of ids.

    A block holds whole documents or a piece of one: documents of over 2 * BLOCK ids are cut into blocks of their own.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), Coder(shared.value)
        seq = at = 0
        full: list[tuple[list, list[np.ndarray], int | None]] = []  # (ids of documents, their token ids, place in the document)
        names, own, n = [], [], 0

        def close() -> None:
            nonlocal names, own, n
            if own:
                full.append((names, own, None))
            names, own, n = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, at
            rows = []
            for (docs, ids, piece_at), (words, states, places) in zip(full, coder.encode([np.concatenate(ids) for _, ids, _ in full])):
                row = {"part": part, "seq": seq, "doc_ids": docs, "n_ids": [len(x) for x in ids], "start_in_part": at, "piece_at": piece_at, "words": words.astype("<u2").tobytes(), "states": states.astype("<u4").tobytes(), "offsets": places.tolist()}
                rows.append(row | {"crc": _checksum(row)})
                seq, at = seq + 1, at + sum(row["n_ids"])
            full.clear()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK_ARROW)

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(ids, kind)
                if len(ids) > 2 * BLOCK:
                    close()
                    full.extend(([doc_id], [ids[k : k + BLOCK]], k) for k in range(0, len(ids), BLOCK))
                else:
                    names.append(doc_id)
                    own.append(ids)
                    n += len(ids)
                    if n >= BLOCK:
                        close()
                if len(full) >= 16:
                    yield from flush()
        close()
        yield from flush()

    own = F.xxhash64("ids")  # so that rows of one id, null too, are dealt over tasks
    dealt = tokens.select("id", "ids").repartitionByRange(partitions, F.col("id"), own).sortWithinPartitions(F.col("id"), own, F.col("ids"))
    return dealt.mapInArrow(run, BLOCK_SCHEMA)


_BLOCK_ARROW = pa.schema([("part", pa.int64()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("start_in_part", pa.int64()), ("piece_at", pa.int64()), ("words", pa.binary()), ("states", pa.binary()), ("offsets", pa.list_(pa.int32())), ("crc", pa.int64())])


def _model_row(freq: np.ndarray, kind: str, end_id: int | None) -> tuple:
    table = freq.astype("<u4").tobytes()
    head = np.array([VERSION, LANES, CHECK, BITS, -1 if end_id is None else end_id], "<i8").tobytes()
    return VERSION, kind, end_id, LANES, CHECK, BITS, bytearray(table), zlib.crc32(table, zlib.crc32(kind.encode(), zlib.crc32(head)))


def store_tokens(docs: DataFrame, spec: str, end_id: int | None, path: str, id_col: str = "doc_id", text_col: str = "text", ids_a_part: int = IDS_A_PART) -> None:
    """Encode every whole text and write ``path``/blocks and ``path``/model, all that ``read_tokens`` needs.

    Null and empty texts have the end id only (none without one). Null ids come first; rows that repeat an id
    follow each other in a fixed order of their ids. There are as many range partitions as the counted ids need.
    An empty table writes no block; very long texts are cut over blocks. Extra columns are not looked at.
    """
    spark = docs.sparkSession
    scratch, kind = Scratch(spark, "tokens"), id_type(spec)
    tokens = scratch.write(token_table(docs, spec, end_id, id_col, text_col), "ids", "zstd")
    counts = count_ids(tokens, vocabulary_size(spec))
    freq = frequency_table(counts)
    spark.createDataFrame([_model_row(freq, kind, end_id)], MODEL_SCHEMA).coalesce(1).write.parquet(f"{path}/model")
    blocks = write_blocks(tokens.where("counts IS NULL"), freq, kind, min(MOST_PARTS, 1 + int(counts.sum()) // ids_a_part))
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    scratch.drop("ids")


def read_tokens(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """(doc_id, start, ids: 32-bit little-endian) of each stored document; start counts the ids of all documents before it.

    With ``digests``, n_tokens and ids_crc32 of the ids read stand for them. A damaged block or model, or files of
    another version, raise an error.
    """
    model = spark.read.schema(MODEL_SCHEMA).parquet(f"{path}/model").first()
    freq = np.frombuffer(model["freq"], "<u4").astype(np.int64)
    if tuple(model) != _model_row(freq, model["id_type"], model["end_id"]):
        raise ValueError("the model is damaged or of another version")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    shared = spark.sparkContext.broadcast(freq)
    scratch = Scratch(spark, "rans-read")
    sums = blocks.select("part", F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of the files
    sums = scratch.write(sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")), "starts")
    # at most MOST_PARTS rows
    placed = blocks.join(F.broadcast(sums), "part").select("part_start", *blocks.columns)
    kind = "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digests else "ids binary")

    def out(names: list, starts: np.ndarray, ids: list[np.ndarray]) -> pa.RecordBatch:
        if digests:
            own = [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
        else:
            own = [pa.array([x.tobytes() for x in ids], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts), *own], names=["doc_id", "start", "n_tokens", "ids_crc32"] if digests else ["doc_id", "start", "ids"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[np.ndarray]]]:
        coder = Coder(shared.value)
        for b in (b.slice(at, 16) for b in batches for at in range(0, len(b), 16)):
            rows = b.to_pylist()
            if any(_checksum(r) != r["crc"] for r in rows):
                raise ValueError("a block's checksum does not match its content")
            yield rows, [x.astype("<u4") for x in coder.decode([(np.frombuffer(r["words"], "<u2"), np.frombuffer(r["states"], "<u4"), np.array(r["offsets"], np.int64), sum(r["n_ids"])) for r in rows])]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, got in decoded(batches):
            starts = [r["part_start"] + r["start_in_part"] + np.cumsum([0, *r["n_ids"][:-1]]) for r in rows]
            ids = [x for r, flat in zip(rows, got) for x in np.split(flat, np.cumsum(r["n_ids"])[:-1])]
            yield out([i for r in rows for i in r["doc_ids"]], np.concatenate(starts).astype(np.int64), ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, got in decoded(batches):
            starts = [r["part_start"] + r["start_in_part"] - r["piece_at"] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_ids"][0] for r in rows], pa.int64()), pa.array(starts), pa.array([r["piece_at"] for r in rows], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())], names=["doc_id", "start", "at", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in x), "<u4") for x in b.column(2).to_pylist()]
            yield out(b.column(0).to_pylist(), b.column(1).to_numpy(), ids)

    long = placed.where("piece_at IS NOT NULL").mapInArrow(pieces, "doc_id long, start long, at long, ids binary")
    long = long.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("pieces"))
    return placed.where("piece_at IS NULL").mapInArrow(whole, kind).unionByName(long.mapInArrow(joined, kind))


def op7_token_store(spark, sf_dir: str) -> DataFrame:
    from .bpe import vocabulary

    path = f"{Scratch(spark, 'store').base}/tokens"
    store_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"), 1, path)
    return read_tokens(spark, path, digests=True)
