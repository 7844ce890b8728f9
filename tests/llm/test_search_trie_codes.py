"""Benchmark search, conversation trie and vector codes against plain Python versions, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import orchard, prefix_trie, wumanber
from sieveline.llm.queries import ORACLE_SQL, QUERIES

CLASHES = ["id", "text_", "words", "spans", "items", "window", "item", "key", "depth", "path", "pos", "part", "at", "n", "low", "own", "code", "error", "v", "of", "row"]


def clashing(df):
    return df.withColumns({c: F.lit(f"<{c}>") for c in CLASHES if c not in df.columns})


# op11


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))


def plain_contamination(docs, bench, size=10):
    windows = defaultdict(set)
    for item, text in bench:
        w = words(text)
        for s in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[s : s + size])].add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    items |= found
                    hit |= set(range(s, s + n))
        spans = [s for s in sorted(hit) if s - 1 not in hit]
        out.append((str(i), len(w), [(s, next(e for e in range(s, len(w) + 1) if e not in hit)) for s in spans], sorted(items)))
    return sorted(out)


def contamination_case():
    r = random.Random(5)
    vocab = ["a", "of", "the", "und", "Straße", "x1", "élan", "9", "中文", "no"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bench = [(k, say(r.choice([1, 3, 9, 10, 11, 25]) if k % 4 == 0 else r.randint(10, 40))) for k in range(1, 30)]
    bench += [(40, None), (41, ""), (42, "... !"), (None, say(12)), (43, bench[7][1]), (7, say(14))]
    bench = [(i, t) for i, t in bench if len(words(t)) != 1 or i == 4]
    docs = []
    for k in range(60):
        parts = [say(r.randint(0, 30))]
        for _ in range(r.randint(0, 2)):
            t = r.choice([t for _, t in bench if t])
            parts += [t.upper().replace("STRASSE", "Straße") if r.random() < 0.3 else ", ".join(t.split(" ")), say(r.randint(0, 9))]
        docs.append((k, "\n".join(parts)))
    long = " ".join(f"w{k}" for k in range(60_000)) + " " + bench[6][1]
    docs += [(100, None), (101, ""), (None, docs[3][1]), (3, docs[3][1]), (102, "a" * 3_000_000 + " " + bench[5][1]), (103, long), (104, docs[5][1] * 50), (105, " ".join(bench[9][1].split(" ")[:9]))]
    return docs, bench


@pytest.mark.parametrize("block_pairs", [200_000, 90])
def test_contamination_equals_brute_force(spark, block_pairs):
    docs, bench = contamination_case()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    got = wumanber.contaminated_words(clashing(d), clashing(b), block_pairs=block_pairs).collect()
    assert sorted((str(x["id"]), x["n_words"], [(s["a"], s["b"]) for s in x["spans"]], x["items"]) for x in got) == plain_contamination(docs, bench)


def test_contamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert wumanber.contaminated_words(docs.limit(0), bench).count() == 0
    row = wumanber.contaminated_words(docs, bench.limit(0)).first()
    assert (row["n_words"], row["spans"], row["items"]) == (3, [], [])
    assert wumanber.contaminated_words(docs, bench).first()["items"] == ["1"]


def test_shifts_skip_most_places():
    r = random.Random(1)
    windows = [" ".join(f"b{r.randint(0, 99)}" for _ in range(10)).encode() for _ in range(200)]
    data = np.frombuffer(" ".join(f"t{r.randint(0, 9999)}" for _ in range(20_000)).encode(), np.uint8)
    search, text = wumanber.Search(windows, 10), wumanber.Words(data, np.array([0, len(data)]))
    assert len(search.ends(text)) < 50 and search.shift.max() == 9


# op12


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(x[3], x[4]) for x in sorted(t)] for c, t in own.items()}
    rest = lambda c: c - int(np.sign(c)) * (abs(c) % 5)
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(rest(c), [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        n = len(members[p])
        leaves = sum(sums[k][0] for k in kids[p]) or 1
        saved = sum(sums[k][1] for k in kids[p]) + ((n - 1) * len(p[-1][1].encode()) if p else 0)
        sums[p] = leaves, saved
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(built[c]) == len(p)))
        out.append((min(members[p]), len(p), str(min(members[p[:-1]])) if p else "None", n, len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie_rows():
    r, rows = random.Random(9), []
    say = lambda: r.choice(["yes", "no", "Größe " * r.randint(0, 3), "", None])
    for c in [*range(60), *range(-7, 0), 2**62]:
        rows += [(c, None if r.random() < 0.05 else k, r.choice(["user", None, "assistant"]) if k % 2 else "user", say()) for k in range(r.randint(1, 12))]
    for c in range(200, 300):  # copies, long ones too
        rows += [(c, k, "user", f"same {k}") for k in range(40 if c % 3 else 150)]
    for c in range(300, 320):  # a comb
        rows += [(c, k, "user", "step") for k in range(c - 299)]
    return [*rows, *rows[:5], (None, 1, "user", "nobody"), (77, 1, "user", "x" * 300_000), (401, 0, "user", "alone")]


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("most_rows", [3, 200])
def test_trie_equals_brute_force(spark, most_rows):
    rows = trie_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = prefix_trie.prefix_trie(clashing(df), most_rows).collect()
    assert sorted(tuple(str(x[c]) if c == "parent_conv_id" else x[c] for c in TRIE) for x in got) == plain_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_digest_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    seqs = spark.range(500).select(F.col("id").alias("conv_id"), F.when(F.col("id") % 50 == 0, F.lit("b")).otherwise("a").alias("seq"))
    got = {x["own"]: x["ends_sha256"] for x in prefix_trie.end_digests(seqs).collect()}
    for name, keep in (("a", lambda k: k % 50), ("b", lambda k: k % 50 == 0)):
        assert got[hashlib.md5(name.encode()).hexdigest()] == hashlib.sha256(",".join(str(k) for k in range(500) if keep(k)).encode()).hexdigest()


# op13


def plain_codes(rows):
    kept = sorted((i, label, [int(np.floor(1024 * x)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    w = len(kept[0][2]) // 4
    parts = [[v[p * w : p * w + w] for p in range(4)] for _, _, v in kept]
    books = [[x[p] for x in parts[:256]] for p in range(4)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(4):
        for p in range(4):
            own = defaultdict(list)
            for x in parts:
                own[near(p, x[p])[1]].append(x[p])
            books[p] = [[sum(c) // len(c) for c in zip(*own[k])] if own[k] else e for k, e in enumerate(books[p])]
    out, by = [], defaultdict(int)
    for (i, label, _), x in zip(kept, parts):
        found = [near(p, x[p]) for p in range(4)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        by[label] += out[-1][3]
    return sorted((i, code, e, by[label]) for i, label, code, e in out), hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("n", [30, 330])
def test_codes_equal_brute_force(spark, tmp_path, n):
    r = np.random.default_rng(n)
    rows = [(k, [float(np.float32(x)) for x in r.standard_normal(8).round(1)], None if k % 11 == 0 else int(k % 3)) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [float("nan")] + [0.0] * 7, 1), (n + 2, [None] * 8, 2), (n + 3, [0.0] * 8, 9), (n + 4, rows[4][1], 1), (n + 5, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    clashing(df).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = orchard.op13_vector_codes(spark, str(tmp_path)).collect()
    want, digest = plain_codes(rows)
    assert sorted((x["vec_id"], x["code"], x["error"], x["label_error"]) for x in got) == want
    assert {x["codebooks_sha256"] for x in got} == {digest}


def test_codes_of_odd_tables(spark):
    make = lambda rows: orchard.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    assert make([])[0].count() == 0 and make([(1, None, "a")])[0].count() == 0
    codes, books = make([(1, [], "a"), (2, [], None)])
    assert sorted((x["id"], x["code"], x["error"]) for x in codes.collect()) == [(1, "00000000", 0), (2, "00000000", 0)]
    # five components are filled up to eight; another length is dropped; huge components are bounded; null ids come last
    codes, books = make([(None, [1e300] * 5, "a"), (3, [0.5] * 5, "a"), (4, [1.0] * 4, "a"), (3, [-1e300] * 5, "a")])
    assert books.shape == (4, 3, 2) and books[0, 0].tolist() == [-(2**25)] * 2 and books[3].tolist() == [[0, 0]] * 3
    assert sorted((str(x["id"]), x["code"], x["error"]) for x in codes.collect()) == [("3", "00000000", 0), ("3", "01010100", 0), ("None", "02020200", 0)]


def test_orchard_search_is_exact():
    r = np.random.default_rng(3)
    for spread in (3, 400):
        entries = r.integers(-spread, spread, (256, 4))
        rows = np.concatenate([r.integers(-spread, spread, (700, 4)), entries[:50]])
        code, dist = orchard.Codebook(entries).nearest(rows)
        every = ((rows[:, None] - entries) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()


# all three against their SQL


@pytest.mark.parametrize("name", ["op11_benchmark_decontamination", "op12_prefix_trie", "op13_vector_codes"])
def test_query_equals_sql(spark, name):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet')")
    df, found = QUERIES[name](spark, path), con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(str([dict(zip(names, r))[c] for c in sorted(names)]) for r in found.fetchall())
    assert sorted(names) == sorted(df.columns) and sorted(str([r[c] for c in sorted(names)]) for r in df.collect()) == want
