"""Conversation prefix trie, built as a burst trie.

A turn is told by a digest of its role and text, a conversation by the sequence of its turns. Equal sequences are
one row with a count. All sequences start in one container under the root. A container with too many sequences
bursts: the turns that all its sequences share become a chain of trie heads, and the rest goes to a container for each
next turn; this repeats until every container is small. Containers are then dealt over tasks, sorted, and swept: each
sequence shares with the one before it the nodes of their common prefix, so a stack yields all nodes. Sums over whole
subtrees go from each container, and each head, to the heads on its path, which is as long as it has burst.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small

#: A container of more sequences, or of more characters of several, bursts.
MOST_ROWS, MOST_CHARS = 200, 1 << 22
#: Turns by which a container may advance in one burst where all its sequences share them.
MOST_SHARED = 64
#: Ids of a digest that are joined at a time.
IDS = 4096
#: A turn: 32 hex digits of its digest, 8 of its text's bytes.
TURN = 40
#: Turns that a rebuilt conversation may take from another one are fewer than this; each of so many in a row takes them from the first.
HEAD, FAMILY = 9, 5


def turn_code(role: Column, text: Column) -> Column:
    """A turn in TURN characters; null role or text is empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.lower(F.hex(F.octet_length(text))), 8, "0"))


def text_bytes(code: Column) -> Column:
    """Bytes of a turn's text from its code; 0 for the root's empty one."""
    return F.coalesce(F.conv(F.nullif(F.substring(code, 33, 8), F.lit("")), 16, 10).cast("long"), F.lit(0).cast("long"))


def numbered_turns(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, code) with pos from 0 by turn, null first, ties by code; and (conv_id, n) per conversation.

    Turns are dealt by range of (conversation, turn, code), so a conversation with very many of them goes to many
    tasks; each task numbers its own, and what earlier tasks hold of the same conversation is added.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            places = []
            for c in batch.column(0).to_pylist():
                last, at = c, (at + 1 if c == last else 0)
                places.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), batch.column(2)], names=["conv_id", "part", "at", "code"])

    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("code")]
    rows = scratch.write(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "code").mapInArrow(number, "conv_id long, part int, at long, code string"), "turns")
    counts = scratch.write(rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")), "turn_counts")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a part has at most one conversation that an earlier part began
    later = counts.withColumn("before", before).where("before > 0").select("conv_id", "part", "before")
    numbered = rows.join(small(later), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "code")
    return numbered, counts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt_sequences(numbered: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, seq): codes of the rebuilt turns of each conversation in ``convs``, joined.

    The first h turns are those of the family's first conversation, all of them if it has fewer, then the own ones after
    the first h follow, with h from a checksum of the id. A conversation's sequence is held in one row, 40 characters a turn.
    """
    h = lambda c: F.crc32(c.cast("string")) % HEAD
    c = F.col("conv_id")
    own = numbered.where(F.col("pos") >= h(c))
    users = F.transform(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1)), lambda j: F.try_add(c, j.cast("long")))
    heads = numbered.where((F.col("pos") < HEAD - 1) & (c % FAMILY == 0)).withColumn("user", F.explode(users))
    heads = heads.where((F.col("user") - F.col("user") % FAMILY == c) & (F.col("pos") < h(F.col("user"))))
    heads = heads.select(F.col("user").alias("conv_id"), "pos", "code").join(convs.select("conv_id"), "conv_id", "left_semi")
    every = own.unionByName(heads).unionByName(convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("code")))
    turns = F.array_sort(F.collect_list(F.struct("pos", "code")))
    return every.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.array_join(F.transform("t", lambda x: x["code"]), "").alias("seq"))


def end_digests(seqs: DataFrame) -> DataFrame:
    """(own, ends_sha256): digest of the ascending decimal ids of the conversations with each sequence.

    Ids are dealt by range of (sequence, id), so those of a frequent sequence go to many tasks, which join them to
    strings of IDS ids; the digest of a sequence then runs over few rows, in order, without holding them.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, ids = None, None, []

        def flush() -> tuple:
            return own, first, ",".join(ids)

        for batch in batches:
            out = []
            for o, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (o != own or len(ids) == IDS):
                    out.append(flush())
                    ids = []
                if not ids:
                    own, first = o, c
                ids.append(str(c))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["own", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in flush()], names=["own", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = None, None
        for batch in batches:
            out = []
            for o, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if o == own:
                    sha.update(b",")
                else:
                    if sha:
                        out.append((own, sha.hexdigest()))
                    own, sha = o, hashlib.sha256()
                sha.update(s.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["own", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([sha.hexdigest()])], names=["own", "ends_sha256"])

    ids = seqs.select(F.md5("seq").alias("own"), "conv_id").repartitionByRange("own", "conv_id").sortWithinPartitions("own", "conv_id")
    joined = ids.mapInArrow(join, "own string, first long, ids string")
    return joined.repartition("own").sortWithinPartitions("own", "first").mapInArrow(digest, "own string, ends_sha256 string")


_CONTAINER = ["key", "depth", "top", "parent", "path", "suffix", "n", "low", "own"]


def burst(seqs: DataFrame, scratch: Scratch, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS) -> tuple[list[DataFrame], list[DataFrame]]:
    """(containers, heads): what is left in small containers, and the chains of heads that burst, each a list of tables.

    A container's rows: key, depth of its top node, top (that node's turn), parent (its parent's smallest member), path
    (keys of the heads above it), and of each sequence suffix, n, low (smallest conversation), own (digest).
    A head's: the same of its first node, chain (the further turns that all share), members, low, kids, own (of the
    sequence that ends at its last node).
    """
    live = seqs.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"))
    live = live.select(
        F.lit("").alias("key"), F.lit(0).alias("depth"), F.lit("").alias("top"), F.lit(None).cast("long").alias("parent"), F.array().cast("array<string>").alias("path"),
        F.col("seq").alias("suffix"), "n", "low", F.md5("seq").alias("own"),
    )
    live, containers, heads, k = scratch.write(live, "live0"), [], [], 0
    while True:
        sizes = live.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.length("suffix")).alias("chars"), F.sum("n").alias("members"), F.min("low").alias("first"))
        over = scratch.write(sizes.where((F.col("rows") > most_rows) | (F.col("rows") > 1) & (F.col("chars") > most_chars)), f"over{k}")
        if over.isEmpty():
            return [*containers, live], heads
        containers.append(live.join(small(over.select("key")), "key", "left_anti").select(*_CONTAINER))
        large = live.join(small(over.select("key", "members", "first")), "key")
        start = F.substring("suffix", 1, MOST_SHARED * TURN)
        found = large.groupBy("key", "depth", "top", "parent", "path", "members", "first").agg(F.min(start).alias("a"), F.max(start).alias("z"))
        same = lambda i: (F.substring("a", F.lit(1), i * TURN) == F.substring("z", F.lit(1), i * TURN)) & (F.length("a") >= i * TURN)
        shared = F.size(F.filter(F.sequence(F.lit(1), F.lit(MOST_SHARED)), same))
        found = scratch.write(found.withColumn("shared", shared).withColumn("chain", F.substring("a", F.lit(1), F.col("shared") * TURN)).drop("a", "z"), f"found{k}")
        rest = large.join(small(found.select("key", "shared")), "key").withColumn("rest", F.expr(f"substring(suffix, shared * {TURN} + 1)"))
        kids = rest.where("rest <> ''").select(
            F.md5(F.concat("key", F.expr(f"substring(suffix, 1, (shared + 1) * {TURN})"))).alias("key"), (F.col("depth") + F.col("shared") + 1).alias("depth"), F.substring("rest", 1, TURN).alias("top"),
            F.col("first").alias("parent"), F.array_append("path", F.col("key")).alias("path"), F.expr(f"substring(rest, {TURN + 1})").alias("suffix"), "n", "low", "own",
        )
        ended = rest.where("rest = ''").select("key", "own")
        live = scratch.write(kids, f"live{k + 1}")
        counts = live.groupBy(F.element_at("path", -1).alias("key"), F.col("key").alias("kid")).agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("kids"))
        heads.append(found.join(small(counts), "key").join(small(ended), "key", "left").select("key", "depth", "top", "parent", "path", "chain", "shared", "members", "first", "kids", "own"))
        k += 1


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, own string, path array<string>"


def _sweep(rows: list[tuple]) -> list[list]:
    """Nodes of one container's rows, sorted by suffix: its top node first, which alone has the path."""
    depth, top, parent, path = rows[0][1:5]
    # conv_id, depth, place of the parent, n_convs, n_children, n_leaves, saved, own, bytes of the last text
    nodes = [[None, depth, -1, 0, 0, 0, 0, None, int(top[32:], 16) if top else 0]]
    stack, before = [0], ""

    def close() -> None:
        node = nodes[stack.pop()]
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * node[8]
        if stack:
            up = nodes[stack[-1]]
            up[0] = node[0] if up[0] is None else min(up[0], node[0])
            up[3], up[4], up[5], up[6] = up[3] + node[3], up[4] + 1, up[5] + node[5], up[6] + node[6]

    for *_, suffix, n, low, own in rows:
        same, most = 0, min(len(suffix), len(before))
        while same < most and suffix[same : same + TURN] == before[same : same + TURN]:
            same += TURN
        while len(stack) > same // TURN + 1:
            close()
        for at in range(same, len(suffix), TURN):
            nodes.append([None, depth + at // TURN + 1, stack[-1], 0, 0, 0, 0, None, int(suffix[at + 32 : at + TURN], 16)])
            stack.append(len(nodes) - 1)
        node = nodes[stack[-1]]
        node[0], node[3], node[7] = low if node[0] is None else min(low, node[0]), node[3] + n, own
        before = suffix
    while stack:
        close()
    return [[x[0], x[1], nodes[x[2]][0] if x[2] >= 0 else parent, *x[3:8], path if x[2] < 0 else None] for x in nodes]


def swept_nodes(containers: list[DataFrame]) -> DataFrame:
    """Nodes of all containers; ``own`` where a sequence ends, ``path`` at a container's top node."""
    names = [x.split()[0] for x in _NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = [], []

        def pieces(least: int) -> Iterator[pa.RecordBatch]:
            while len(out) > least:
                piece = [list(x) for x in zip(*out[:10_000])]
                del out[:10_000]
                kinds = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(piece, kinds)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(_CONTAINER)))):
                if held and held[0][0] != row[0]:
                    out += _sweep(held)
                    held = []
                    yield from pieces(10_000)
                held.append(row)
        if held:
            out += _sweep(held)
        yield from pieces(0)

    rows = containers[0]
    for more in containers[1:]:
        rows = rows.unionByName(more)
    return rows.select(*_CONTAINER).repartition("key").sortWithinPartitions("key", "suffix").mapInArrow(run, _NODE)


def head_nodes(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the heads' chains, with the sums over all that is below them."""
    sizes = F.concat(F.array(text_bytes(F.col("top"))), F.when(F.col("shared") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("shared") - 1, F.lit(0))), lambda i: text_bytes(F.substring("chain", i * TURN + 1, F.lit(TURN))))).otherwise(F.array().cast("array<bigint>")))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    heads = heads.withColumn("sizes", sizes)
    own_saved = (F.col("members") - 1) * total(F.col("sizes"))
    given = nodes.where("path IS NOT NULL").select("path", "n_leaves", "saved_tokens").unionByName(heads.select("path", F.lit(0).cast("long").alias("n_leaves"), own_saved.alias("saved_tokens")))
    below = given.select(F.explode("path").alias("key"), "n_leaves", "saved_tokens").groupBy("key").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    j, last = F.col("j"), F.col("j") == F.col("shared")
    rows = heads.join(small(below), "key").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("shared"))))
    return rows.select(
        F.col("first").alias("conv_id"), (F.col("depth") + j).cast("long").alias("depth"), F.when(j == 0, F.col("parent")).otherwise(F.col("first")).alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("members") - 1) * total(F.slice("sizes", j + 1, F.col("shared") + 1 - j))).alias("saved_tokens"), F.when(last, F.col("own")).alias("own"),
    )


def prefix_trie(turns: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations, from columns conv_id, turn, role, text.

    Turns are ordered by ``turn``, null first; turns of one place are ordered by the digest of role and text, and
    repeated rows are turns of their own. Null role or text is empty; very long texts count whole, by digest and
    bytes. Rows without a conv_id are of no conversation and take no part; other columns are not read. An empty table
    has no node; else the root has depth 0, no parent, and all conversations, turnless ones too.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    base = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_code(F.col("role"), F.col("text")).alias("code"))
    numbered, convs = numbered_turns(base, scratch)
    seqs = scratch.write(rebuilt_sequences(numbered, convs), "seqs")
    containers, parts = burst(seqs, scratch, most_rows)
    nodes = scratch.write(swept_nodes(containers), "nodes")
    every = nodes.drop("path")
    if parts:
        heads = parts[0]
        for more in parts[1:]:
            heads = heads.unionByName(more)
        every = every.unionByName(scratch.write(head_nodes(scratch.write(heads, "heads"), nodes), "head_nodes"))
    ended = every.where("own IS NOT NULL").join(end_digests(seqs), "own").drop("own")
    return ended.unionByName(every.where("own IS NULL").drop("own").withColumn("ends_sha256", F.sha2(F.lit(""), 256)))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    found = prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_BIT = "xor(x >> 1, 3988292384 * (x & 1))"  # a step of CRC-32
_CRC = "xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), x -> CAST(ascii(x) AS BIGINT)), lambda a, b: xor(a >> 8, t.crc[CAST(xor(a, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)".replace("x -> ", "lambda x: ")

OP12_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS x, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, {_BIT}, k + 1 FROM bits WHERE k < 8),
t AS (SELECT list(x ORDER BY i) AS crc FROM bits WHERE k = 8),
o AS (SELECT conv_id AS c, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS code, strlen(coalesce(text, '')) AS bytes,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM o), t),
r AS (SELECT v.c, o.pos, o.code, o.bytes FROM v JOIN o ON o.c = v.c AND o.pos >= v.h
      UNION ALL SELECT v.c, o.pos, o.code, o.bytes FROM v JOIN o ON o.c = v.c - v.c % 5 AND o.pos < v.h),
p AS (SELECT c, bytes, row_number() OVER w AS depth, list(code) OVER (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path
      FROM r WINDOW w AS (PARTITION BY c ORDER BY pos)),
q AS (SELECT c, 0 AS depth, '' AS node, CAST(NULL AS VARCHAR) AS up, 0 AS bytes FROM v
      UNION ALL SELECT c, depth, array_to_string(path, ''), array_to_string(path[1 : depth - 1], ''), bytes FROM p),
len AS (SELECT c, max(depth) AS depth FROM q GROUP BY c),
n AS (SELECT node, any_value(up) AS up, any_value(q.depth) AS depth, min(q.c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own,
      string_agg(CAST(q.c AS VARCHAR), ',' ORDER BY q.c) FILTER (WHERE len.depth = q.depth) AS ends
      FROM q JOIN len USING (c) GROUP BY node),
k AS (SELECT up AS node, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT substr(node, 1, 32 * d) AS node, sum(own) AS saved, count(*) FILTER (WHERE kids IS NULL) AS leaves
      FROM (SELECT node, own, kids, unnest(range(0, depth + 1)) AS d FROM n LEFT JOIN k USING (node)) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.kids, 0) AS n_children, a.leaves AS n_leaves,
       CAST(a.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n LEFT JOIN n u ON n.up = u.node LEFT JOIN k ON k.node = n.node JOIN a ON a.node = n.node
"""
