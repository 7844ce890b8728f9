"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a random non-zero vector of radius + 1 bits; table v (a non-zero vector of the same
length) keeps the positions whose vector has an odd inner product with v. Up to ``radius`` differing positions
never span the whole space, so some v is orthogonal to all of them: every pair within the radius agrees on all
the bits of that table. With radius 3 there are 15 tables, each on about 34 of the 64 bits.

The pipeline's stage, whose radius is larger, deals its bits into parts with a covering each (``stage_masks``).

Only distinct fingerprints are compared. In op3 a bucket is never expanded into its pairs: groups of at most two
blocks of it are tested in numpy and only a spanning forest of their links leaves the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_whole_groups, connected_components, cut_blocks, forest, free_names, in_blocks, pairs_in_groups

SEED = 42
#: The stage of the pipeline: words a shingle, least Jaccard similarity, most differing bits of 128 (19 on average at 0.8).
STAGE_WORDS = 5
SIMILARITY = 0.8
STAGE_RADIUS = 34
#: Before candidates are joined they must agree in this share of LEAST one-byte least hashes: pairs of similarity 0.8
#: agree in 0.8 of them with a deviation of 0.07, so in 0.4 but for one in 10^8, and unlike texts in one of 255.
LEAST, LEAST_SHARE = 32, 0.4
#: A row of a table is taken to cost as much as this many rows in its bucket; rows compared side by side.
ROW_COST, TILE = 2**17, 32


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a text's word shingles (repeats count); 0 where there is no word."""
    # bytes.lower() and bytes.split() know ASCII only, as wanted: A-Z, and the six white-space characters
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_digest
    if len(parts) <= words:
        hashes = digest(joined, SEED)
    else:
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = np.concatenate([[0], ends[: -words]]).tolist()
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())])
    h = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) of each row: fp is the fingerprint as a signed long. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks over 64 bits; any two words within the radius agree on all the bits of one of them."""
    vectors = np.random.default_rng(seed).integers(1, 2 ** (radius + 1), 64)
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        odd = np.bitwise_count(vectors & v) & 1
        masks.append(int(sum(1 << k for k in range(64) if odd[k])))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(distinct: DataFrame, scratch: Scratch, radius: int = 3, block: int = 1024) -> DataFrame:
    """Links (a, b) over distinct fingerprints (column fp) that join exactly those which links of <= radius bits join."""
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(covering_masks(radius))])
    rows = distinct.select("fp", F.explode(keys).alias("x")).select(F.xxhash64("x.t", "x.key").alias("bucket"), F.col("fp").alias("id"))

    def work(t: pa.Table, g: np.ndarray) -> pa.Table | None:
        fp = t["id"].to_numpy()
        bits = fp.view(np.uint64)  # of a negative number, bitwise_count would count the bits of its absolute value
        own, i, j = (t[c].to_numpy() for c in ("own", "i", "j"))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in pairs_in_groups(g, own, i, j):
            near = np.bitwise_count(bits[a] ^ bits[b]) <= radius
            if near.any():
                found.append((a[near], b[near]))
        if not found:
            return None
        label = forest(len(fp), np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
        at = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"a": fp[at], "b": fp[label[at]]})

    dealt = in_blocks(rows, scratch, "tables", block)
    return dealt.select("bucket", "i", "j", "own", "id").mapInArrow(lambda it: by_whole_groups(it, ["bucket", "i", "j"], work), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component_id) of each row of ``docs``.

    component_id is the smallest id that links of at most ``radius`` differing bits reach, the row's own
    included. Rows with a null id take part and get the component's smallest id, null where it has none;
    repeated rows stay repeated. Texts of any length count whole. An empty table gives an empty result. Other columns
    are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = scratch.write(marked.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    links = scratch.write(fingerprint_links(nodes, scratch, radius).distinct(), "links")
    roots = scratch.write(connected_components(links, scratch), "roots")
    known = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = scratch.write(known, "known")
    least = scratch.write(known.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    found = scratch.write(known.join(least, "root").select("fp", "component_id"), "members")
    return marked.join(found, "fp").select("id", "fp", "component_id")


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash_components(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int = STAGE_WORDS) -> tuple[np.ndarray, bytes]:
    """(sorted distinct 64-bit hashes of a text's word shingles, its 128-bit SimHash over them, each counted once)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64), bytes(16)
    joined = b" ".join(parts)
    digest = xxhash.xxh3_128_digest
    if len(parts) <= words:
        hashes = digest(joined, SEED)
    else:
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = np.concatenate([[0], ends[: -words]]).tolist()
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())])
    h = np.frombuffer(hashes, np.uint8).reshape(-1, 16)
    own, at = np.unique(np.ascontiguousarray(h[:, :8]).view(np.uint64).reshape(-1), return_index=True)
    ones = np.zeros(128, np.int64)
    for k in range(0, len(at), 4096):
        ones += np.unpackbits(h[at[k : k + 4096]], axis=1).sum(axis=0, dtype=np.int64)
    return own, np.packbits(2 * ones > len(at)).tobytes()


def stage_masks(total: int, radius: int = STAGE_RADIUS, seed: int = 11) -> np.ndarray:
    """Covering masks (tables, 2) over 128 bits: any two words within the radius agree on all the bits of one of them.

    One covering of the whole radius would take 2^(radius + 1) - 1 tables, so the bits are dealt into parts. Their radii
    and one more for each part add up to radius + 1, so in some part the two words differ in no more than its radius, and
    its own covering has a table on which they agree. Fewer and larger parts take more tables, on more bits each: of the
    plans, all of them certain, the one is taken whose rows and comparisons for ``total`` words cost least.
    """

    def cost(r: int) -> float:
        parts, tables = math.ceil((radius + 1) / (r + 1)), 2 ** (r + 1) - 1
        return parts * tables * (1 + total / 2 ** (128 / parts * 2**r / tables) / ROW_COST)

    most = min(range(min(radius, 11) + 1), key=cost)
    parts = math.ceil((radius + 1) / (most + 1))
    random, masks = np.random.default_rng(seed), []
    for k, own in enumerate(np.array_split(random.permutation(128), parts)):
        tables = 2 ** (most + (k >= parts * (most + 1) - radius - 1)) - 1
        # of some draws of the vectors that which leaves no table with few bits
        draws = [np.resize(1 + random.permutation(tables), len(own)) for _ in range(50)]
        odd = [(np.bitwise_count(vectors & np.arange(1, tables + 1)[:, None]) & 1) == 1 for vectors in draws]
        for row in min(odd, key=lambda x: (0.5 ** x.sum(axis=1)).sum()):
            masks.append([sum(1 << int(x % 64) for x in own[row] if x // 64 == half) for half in (0, 1)])
    return np.array(masks, np.uint64)


def least_hashes(own: np.ndarray) -> bytes:
    """A byte for each of LEAST classes of hashes, from the smallest hash of a class in the sorted set; 0 for an empty class."""
    out = np.zeros(LEAST, np.uint8)
    falling = own[::-1]  # of one class the last one written is the smallest
    out[(falling % np.uint64(LEAST)).astype(np.int64)] = 1 + (falling >> np.uint64(8)) % np.uint64(255)
    return out.tobytes()


def _share(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the least hashes of the rows a and b agree in a share of LEAST_SHARE of the classes that either has, or have none."""
    x, y = least[a], least[b]
    either = ((x | y) > 0).sum(axis=1)
    return ((x == y) & (x > 0)).sum(axis=1) >= LEAST_SHARE * either


def _alike(f0, f1, n, a, b) -> tuple[np.ndarray, np.ndarray]:
    """(whether fingerprints and sizes of the rows a and b allow the similarity, differing bits)."""
    d = np.bitwise_count(f0[a] ^ f0[b]) + np.bitwise_count(f1[a] ^ f1[b])
    return (d <= STAGE_RADIUS) & (np.minimum(n[a], n[b]) >= SIMILARITY * np.maximum(n[a], n[b])), d


def _in_reach(t: pa.Table, g: np.ndarray) -> pa.Table | None:
    """Links of a forest that joins what pairs in reach join, within each group, whose rows are sorted by n.

    A row meets the following ones up to the size that the similarity allows, so a group costs less than all its pairs;
    links are merged as they come, so a group of copies does not hold its pairs.
    """
    f0, f1 = (t[c].to_numpy().view(np.uint64) for c in ("f0", "f1"))
    own, i, j, n, ids = (t[c].to_numpy() for c in ("own", "i", "j", "n", "id"))
    least, out = np.frombuffer(b"".join(t["least_hashes"].to_pylist()), np.uint8).reshape(-1, LEAST), []
    edges = np.append(np.flatnonzero(np.diff(g, prepend=-1)), len(g)).tolist()
    for s, e in zip(edges[:-1], edges[1:]):
        label = np.arange(e - s)
        upto = s + np.searchsorted(SIMILARITY * n[s:e], n[s:e], side="right")
        for x in range(s, e, TILE):
            y = min(x + TILE, e)
            z = int(upto[y - 1 - s])
            d = np.bitwise_count(f0[x:y, None] ^ f0[x:z]) + np.bitwise_count(f1[x:y, None] ^ f1[x:z])
            a, b = (v + x for v in np.nonzero(d <= STAGE_RADIUS))
            ok = (a < b) & (label[a - s] != label[b - s])
            if i[s] != j[s]:
                ok &= own[a] != own[b]
            a, b = a[ok], b[ok]
            ok, _ = _alike(f0, f1, n, a, b)
            a, b = a[ok], b[ok]
            ok = _share(least, a, b)
            if ok.any():
                label = forest(e - s, label[a[ok] - s], label[b[ok] - s])[label]
        at = np.flatnonzero(label != np.arange(e - s))
        if len(at):
            out.append(pa.table({"a": ids[s + at], "b": ids[s + label[at]]}))
    return pa.concat_tables(out) if out else None


def candidate_links(nodes: DataFrame, scratch: Scratch, block: int = 65_536) -> DataFrame:
    """Links (a, b) over classes (cls, f0, f1, n, least_hashes) that join exactly what all pairs in reach join; no shingles are needed.

    In reach are fingerprints within STAGE_RADIUS, each pair of which meets in a covering table, of sizes that allow the
    similarity. A table is cut by size, too: a class stands in the range of its own size and, where that is another
    one, of the least size that a partner may have. Of many texts some that have nothing in common are in reach by chance,
    and they would run together to ever larger components; their least hashes tell them apart, so components hold
    texts that share a part of their shingles.
    """
    masks = [F.struct(F.lit(k).alias("t"), F.lit(_signed(int(x))).alias("x"), F.lit(_signed(int(y))).alias("y")) for k, (x, y) in enumerate(stage_masks(nodes.count()))]
    within = lambda n: F.floor(F.log(F.greatest(n, F.lit(0.5))) / math.log(SIMILARITY**-4))
    sizes = F.array_distinct(F.array(within(F.col("n").cast("double")), within(F.col("n") * (SIMILARITY - 1e-9))))
    rows = nodes.select("cls", "f0", "f1", "n", "least_hashes", F.explode(sizes).alias("size")).withColumn("k", F.explode(F.array(*masks)))
    bucket = F.xxhash64("size", "k.t", F.col("f0").bitwiseAND(F.col("k.x")), F.col("f1").bitwiseAND(F.col("k.y")))
    rows = rows.select(bucket.alias("bucket"), F.col("cls").alias("id"), "f0", "f1", "n", "least_hashes")
    dealt = cut_blocks(rows, scratch, "tables", block).select("bucket", "i", "j", "own", "id", "f0", "f1", "n", "least_hashes")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "n")
    return dealt.mapInArrow(lambda it: by_whole_groups(it, ["bucket", "i", "j"], _in_reach), "a long, b long")


def _confirmed(t: pa.Table, g: np.ndarray) -> pa.Table | None:
    """Links of a forest that joins what pairs of similarity >= SIMILARITY join, within each group.

    With a column ``side`` only rows of different sides are compared, and rows of one ``root`` are joined already.
    """
    f0, f1 = (t[c].to_numpy().view(np.uint64) for c in ("f0", "f1"))
    n, ids, held, up = t["n"].to_numpy(), t["id"].to_numpy(), t["shingles"], np.arange(len(t)).tolist()
    side, known = (t[c].to_numpy() if c in t.column_names else None for c in ("side", "root"))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    edges = np.append(np.flatnonzero(np.diff(g, prepend=-1)), len(g)).tolist()
    for s, e in zip(edges[:-1], edges[1:]):
        if known is not None:
            first: dict[int, int] = {}
            for k, r in enumerate(known[s:e].tolist(), s):
                up[k] = first.setdefault(r, k)
        a, b = (x + s for x in np.triu_indices(e - s, 1))
        if side is not None:
            a, b = a[side[a] != side[b]], b[side[a] != side[b]]
        ok, d = _alike(f0, f1, n, a, b)
        a, b = a[ok], b[ok]
        for k in np.argsort(d[ok], kind="stable").tolist():
            x, y = root(int(a[k])), root(int(b[k]))
            if x == y:
                continue
            one, two = (np.frombuffer(held[int(z[k])].as_buffer(), np.uint64) for z in (a, b))
            both = len(np.intersect1d(one, two, assume_unique=True))
            if both >= SIMILARITY * (len(one) + len(two) - both):
                up[max(x, y)] = min(x, y)
                out.append((ids[a[k]], ids[b[k]]))
    return pa.table({"a": np.array([x for x, _ in out], np.int64), "b": np.array([y for _, y in out], np.int64)}) if out else None


def confirmed_links(members: DataFrame, scratch: Scratch, block: int = 512) -> DataFrame:
    """Links over ``members`` (id, bucket: candidate component, f0, f1, n, shingles), each confirmed by the shingles.

    A component of at most ``block`` classes is one group. A larger one is dealt into blocks; then one class of each
    component found so far is compared with those of the other blocks; and what is still outside the largest of them
    is compared with all of the component. So no pair in reach is lost, and a large group of near copies costs one
    comparison or so a class after the blocks, not all its pairs.
    """
    cols = ["f0", "f1", "n", "shingles"]

    def linked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
        return scratch.write(dealt.mapInArrow(lambda it: by_whole_groups(it, keys, _confirmed, 1000), "a long, b long"), name)

    sizes = scratch.write(members.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("nb")), "component_sizes")
    placed = members.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("id", F.lit(23)), F.col("nb")).cast("int"))
    links = linked(placed.select("bucket", "part", "id", *cols), ["bucket", "part"], "links1")
    if not sizes.where("nb > 1").limit(1).count():
        return links
    large = scratch.write(members.join(sizes.where("nb > 1"), "bucket"), "large")

    def rooted(upto: DataFrame, name: str) -> DataFrame:
        roots = connected_components(upto, Scratch(scratch.spark, "roots")).withColumnRenamed("node", "id")
        return scratch.write(large.select("bucket", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), name)

    heads = rooted(links, "rooted1").where("id = root").select("id")
    dealt = in_blocks(large.join(heads, "id").drop("nb"), scratch, "heads", block).select("bucket", "i", "j", "id", *cols)
    links = links.unionByName(linked(dealt, ["bucket", "i", "j"], "links2"))
    roots = rooted(links, "rooted2")
    most = roots.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
    outside = roots.join(most, "bucket").where("root <> most").select("bucket", "id", "root")
    left = scratch.write(outside.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("ns")), "outside_sizes")
    if not left.limit(1).count():
        return links
    both = large.join(left, "bucket").join(roots.drop("bucket"), "id")
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(29)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = ["bucket", "i", "j"]
    ours = both.join(outside.select("id"), "id", "left_semi").withColumn("side", F.lit(0)).withColumn("i", own("ns")).withColumn("j", every("nb"))
    all_of = both.withColumn("side", F.lit(1)).withColumn("j", own("nb")).withColumn("i", every("ns"))
    rows = ours.unionByName(all_of).select(*cells, "side", "root", "id", *cols)
    return links.unionByName(linked(rows, cells, "links3"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, null ids last, ties by a digest of the text.

    Texts link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more; candidates are
    all pairs of SimHashes within STAGE_RADIUS bits, by covering tables; few similar pairs differ in more (see the README). Rows are told
    apart by id and text, so null and repeated ids hide no other text; of rows that repeat both, one stays. Texts
    without words, null ones too, are one group. Columns stay as they are, whatever their names; very long texts count
    whole; an empty table gives an empty result. Ids are whole numbers.
    """
    scratch = Scratch(docs.sparkSession, "simhash-kept")
    text, id_long = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    # a key of id and text without nulls, so that joins and aggregates on it share one partitioning
    key = {"own": F.coalesce(id_long, F.lit(0)), "dig": F.xxhash64(id_long.isNull(), text)}
    keyed = docs.select(id_long.alias("id"), key["dig"].alias("dig"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(x) for x in b.column(2).to_pylist()]
            cls = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s, _ in found], np.uint64).view(np.int64)
            f = np.frombuffer(b"".join(x for _, x in found), np.int64).reshape(-1, 2)
            n = np.array([len(s) for s, _ in found], np.int32)
            least = pa.array([least_hashes(s) for s, _ in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(x)) for x in (cls, f[:, 0], f[:, 1], n)), least], names=["id", "dig", "cls", "f0", "f1", "n", "least_hashes"])

    marked = scratch.write(keyed.mapInArrow(run, "id long, dig long, cls long, f0 long, f1 long, n int, least_hashes binary"), "marked")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "dig")
    # the fingerprints follow from the class, so as keys they cost nothing and keep the aggregation in hash tables
    nodes = marked.groupBy("cls", "f0", "f1", "n", "least_hashes").agg(F.min(row).alias("least"))
    nodes = scratch.write(nodes, "nodes")
    near = scratch.write(candidate_links(nodes, scratch).distinct(), "near")
    near = connected_components(near, Scratch(docs.sparkSession, "near")).select(F.col("node").alias("cls"), F.col("root").alias("bucket"))
    wanted = scratch.write(nodes.drop("least_hashes").join(near, "cls"), "wanted")
    asked = wanted.select("cls", F.coalesce("least.id", F.lit(0)).alias("own"), F.col("least.dig").alias("dig")).hint("merge")
    texts = keyed.withColumn("own", F.coalesce("id", F.lit(0))).join(asked, ["own", "dig"]).select("cls", "text").dropDuplicates(["cls"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(at, 1000) for batch in batches for at in range(0, len(batch), 1000)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x)[0].tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["cls", "shingles"])

    members = wanted.join(texts.mapInArrow(sets, "cls long, shingles binary"), "cls").select(F.col("cls").alias("id"), "bucket", "f0", "f1", "n", "shingles")
    links = confirmed_links(scratch.write(members, "members"), scratch)
    roots = connected_components(links, scratch).withColumnRenamed("node", "cls")
    known = nodes.select("cls", "least").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    stay = known.groupBy("root").agg(F.min("least").alias("least"))
    own, dig = free_names(docs, "_own", "_dig")
    stay = scratch.write(stay.select(F.coalesce("least.id", F.lit(0)).alias(own), F.col("least.dig").alias(dig)), "stay")
    # one shuffle of the texts, after a partial aggregation: repeated rows meet on the key that the join needs, too
    rows = docs.withColumns({own: key["own"], dig: key["dig"]}).dropDuplicates([own, dig])
    return rows.join(stay.hint("merge"), [own, dig]).select(*[F.col(f"`{c}`") for c in docs.columns])
