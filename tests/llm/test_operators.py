"""Corpus operators against brute force, with nulls, empty texts, ties and repeated rows."""

import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sieveline.llm import bpe, common, itq, knn, langid, lines, mixing, rans, simhash, substrings, toxicity

DOCS = "doc_id long, text string, source string, fp int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], DOCS)


def odd_rows():
    return [(1, None, "a"), (2, "", None), (3, "one two three four five six", "a"), (3, "one two three four five six", "a"), (4, "x" * 5000, "b"), (None, "with no id", "b"), (5, "1 2 3", None)]


TEXTS = ["", "a" * 1000, "ab" * 300, "  \n x", "<|endoftext|> a<|startoftext|>", "İ. Σ. H̱, word. Word,"]


def fuzz(n=300):
    r = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "ß", "Σ", "'s", "<|endoftext|>", "1", "½", "漢", "́", ".", ",", "\xa0", "The"]
    return TEXTS + ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(n)]


def test_bpe_equals_library():
    spec = bpe.vocabulary("byte_bpe_50k.json")
    own, lib = bpe.BytePairs(spec), Tokenizer.from_str(spec)
    for t in fuzz():
        ids = np.frombuffer(own.encode(t), "<u4").tolist()
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_odd_ids_and_full_memories(monkeypatch):
    own = bpe.BytePairs(bpe.vocabulary("byte_bpe_50k.json"))
    texts = [" ".join(f"word{k * 7 % 40} x{k}, " for k in range(60)), "a\n\nb  c", "é" * 300]
    ids = [own.encode(t) for t in texts]
    known = np.frombuffer(ids[0], "<u4").tolist()
    assert own.decode([-1, *known, 10**6]) == texts[0]
    assert own.decode([]) == ""
    monkeypatch.setattr(bpe, "MEMORY", 5)
    monkeypatch.setattr(bpe, "CHUNK_MEMORY", 3)
    small = bpe.BytePairs(bpe.vocabulary("byte_bpe_50k.json"))
    assert [small.encode(t) for t in texts] == ids
    assert len(small.words) <= 5 and len(small.chunks) <= 3


def test_chunks_equal_library():
    spec = bpe.vocabulary("word_bpe_49k.json")
    lib, texts = Tokenizer.from_str(spec), fuzz()
    for t, got in zip(texts, rans.Chunks(spec).encode(texts)):
        assert np.frombuffer(got, "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("symbols", [1, 5, 49408])
def test_rans_round_trip(symbols):
    r = np.random.default_rng(0)
    ids = [r.zipf(1.3, n).clip(1, symbols) - 1 for n in (1, 31, 32, 33, 0, 16384, 16385, 140_000)]
    coder = rans.Coder(rans.frequency_table(np.bincount(np.concatenate(ids), minlength=symbols)))
    back = coder.decode([(*e, len(i)) for e, i in zip(coder.encode([i.astype(np.uint32) for i in ids]), ids)])
    assert all(np.array_equal(a, b) for a, b in zip(ids, back))


def stored(spark, rows, monkeypatch, block=1 << 16, ids_a_part=1 << 22):
    monkeypatch.setattr(rans, "BLOCK", block)
    path = common.Scratch(spark, "t").base
    rans.store_tokens(docs(spark, rows).repartition(3), bpe.vocabulary("word_bpe_49k.json"), 1, path, ids_a_part=ids_a_part)
    return path


def test_token_store(spark, monkeypatch):
    texts = fuzz(100)
    # a text over several blocks, a null and an empty one, null and repeated ids
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(500, "long word, " * 3000, "s"), (501, None, "s"), (502, "", "s"), (None, "no id", "s"), (None, "no id", "s"), (None, "x", "s"), (503, "b", "s"), (503, "a", "s")]
    path = stored(spark, rows, monkeypatch, block=1024, ids_a_part=500)
    lib = Tokenizer.from_str(bpe.vocabulary("word_bpe_49k.json"))
    got = spark.newSession() and rans.read_tokens(spark.newSession(), path).orderBy("start").collect()  # a session that knows the files only
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    want, start = sorted((-1 if i is None else i, tuple(lib.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, _ in rows), 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["start"] == start
        start += len(ids)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    digests = {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rans.read_tokens(spark, path, digests=True).collect()}
    assert digests == {(r["doc_id"], r["start"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in got}


def test_token_store_empty(spark, monkeypatch):
    assert rans.read_tokens(spark, stored(spark, [], monkeypatch)).count() == 0


def test_token_store_finds_damage(spark, monkeypatch):
    path = stored(spark, [(k, f"text {k} of some words", "s") for k in range(30)], monkeypatch)
    block = spark.read.parquet(f"{path}/blocks").first().asDict()
    flip = lambda b: bytes([b[0] ^ 1]) + bytes(b[1:])
    damaged = {"words": flip(block["words"]), "states": flip(block["states"]), "offsets": [x + 1 for x in block["offsets"]], "doc_ids": [block["doc_ids"][0] + 1, *block["doc_ids"][1:]], "n_ids": [x + 1 for x in block["n_ids"]], "start_in_part": 7, "part": 9, "seq": 5, "piece_at": 3, "crc": block["crc"] ^ 1}
    for column, value in damaged.items():
        other = common.Scratch(spark, "t").base
        spark.read.parquet(f"{path}/model").write.parquet(f"{other}/model")
        spark.createDataFrame([tuple({**block, column: value}.values())], rans.BLOCK_SCHEMA).write.parquet(f"{other}/blocks")
        with pytest.raises(Exception, match="checksum"):
            rans.read_tokens(spark, other).collect()
    model = spark.read.parquet(f"{path}/model").first().asDict()
    for column, value in {"version": 1, "id_type": "<u4", "end_id": 2, "freq": bytearray(flip(model["freq"])), "crc": 0}.items():
        other = common.Scratch(spark, "t").base
        spark.createDataFrame([tuple({**model, column: value}.values())], rans.MODEL_SCHEMA).write.parquet(f"{other}/model")
        with pytest.raises(ValueError, match="model"):
            rans.read_tokens(spark, other)


def brute_simhash(text):
    words = text.lower().split() if text else []
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_components(spark):
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghij") * 2 for _ in range(60)) for _ in range(30)]
    rows = [(k, base[k % 30] + (" zz" if k % 3 else ""), "s") for k in range(120)] + [(900, None, "s"), (901, "", "s")]
    fp = {k: brute_simhash(t) for k, t, _ in rows}
    low = {k: k for k in fp}
    for _ in range(6):
        for a in fp:
            low[a] = min(low[b] for b in fp if (fp[a] ^ fp[b]).bit_count() <= 3)
    got = {r["id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_components(docs(spark, rows)).collect()}
    assert got == {k: (fp[k], low[k]) for k in fp}
    assert simhash.keep_one_of_each(docs(spark, rows)).count() == len(set(low.values()))


def test_covering():
    r, masks = np.random.default_rng(5), simhash.covering_masks(3)
    for _ in range(500):
        x = int(r.integers(0, 2**63))
        y = x ^ sum(1 << int(k) for k in r.choice(64, 3, replace=False))
        assert any((x & m) == (y & m) for m in masks)


def test_simhash_links_across_the_top_bit(spark):
    r, rows, near = np.random.default_rng(8), [], set()
    for bits in ((63, 5), (63, 5, 40), (60, 61, 62, 63)):
        x = int(r.integers(0, 2**63))
        pair = [z - 2**64 if z >> 63 else z for z in (x, x ^ sum(1 << k for k in bits))]
        rows += [(z,) for z in pair]
        near |= {frozenset(pair)} if len(bits) <= 3 else set()
    got = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long"), common.Scratch(spark, "t")).collect()
    assert {frozenset((x["a"], x["b"])) for x in got} == near


def test_stage_keeps_one_of_near_copies(spark):
    r, rows, low = random.Random(9), [], {}
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    for k in range(60):
        base = [word() for _ in range(200)]
        for c, changed in enumerate(([], [20], [100, 160], [150, 20, 60, 110, 170, 190])):
            text = [word() if at in changed else w for at, w in enumerate(base)]
            rows.append((10 * k + c, " ".join(text), "s"))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t, _ in rows}
    for i in sets:  # the copies of one base are neighbours in the ids
        low[i] = min(low.get(j, j) for j in sets if j // 10 == i // 10 and j <= i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = {x["doc_id"] for x in simhash.keep_one_of_each(docs(spark, rows)).collect()}
    want = set(low.values())
    assert len(want) == 120 and want <= got and len(got - want) <= 6
    # one large group of near copies
    many = [(1000 + k, " ".join([*("w%d" % x for x in range(300)), word()]), "s") for k in range(150)]
    assert [x["doc_id"] for x in simhash.keep_one_of_each(docs(spark, many)).collect()] == [1000]


def test_stage_tells_rows_apart_by_text(spark):
    rows = [(None, f"text {k} of its own {k * 7}", "s") for k in range(4)] * 2 + [(5, "one text of five", "s"), (5, "another text of five", "s"), (5, "one text of five", "s")]
    got = sorted(x["text"] for x in simhash.keep_one_of_each(docs(spark, rows)).collect())
    assert got == sorted({t for _, t, _ in rows})


def test_substrings(spark):
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    shared = prose(60)
    rows = [(1, prose(100) + shared + prose(50), "a"), (2, prose(77) + shared + prose(10), "a"), (3, prose(200), "a")]
    got = substrings.repeated_spans(docs(spark, rows + odd_rows()[:2])).collect()
    assert [(r["id"], r["first_id"]) for r in got] == [(2, 1)] and got[0]["n_bytes"] > 200
    data = rows[0][1].encode()
    ends = substrings.cuts(data)
    assert ends[-1] == len(data) and (np.diff(ends, prepend=0) <= substrings.MAX_CHUNK).all()


def test_lines(spark):
    rows = [(k, "menu\n" + f"own {k}\nown {k}", "h") for k in range(10)] + [(20, None, "h"), (21, "menu", None)]
    d = docs(spark, rows)
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(d, F.col("source"), F.col("text")).collect()}
    assert got[3] == "own 3\nown 3" and got[20] == "" and got[21] == "menu" and len(got) == 12


def test_substrings_tell_rows_apart_by_text(spark):
    r = random.Random(12)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    shared, other = prose(60), prose(60)
    # at equal places, so that places alone tell nothing
    rows = [(None, shared + prose(40), "a"), (None, shared + prose(40), "a"), (7, other + prose(40), "a"), (7, other + prose(40), "a"), (7, other + prose(40), "a")]
    got = [(x["id"], x["first_id"], x["start"]) for x in substrings.repeated_spans(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == [(7, 7, 0), (7, 7, 0), (None, None, 0)]


def test_stage_drops_repeated_lines_of_large_sources(spark):
    rows = [(k, f"own {k}\n" + ("planted\n" if k % 40 == 0 else "") + (f"few {k // 150}\n" if k % 150 < 3 else "") + f"end {k}", "h") for k in range(600)]
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.line_dedup(spark, docs(spark, rows), "").collect()}
    assert got == {k: t.replace("planted\n", "") for k, t, _ in rows}


def test_op5_on_a_large_host_with_many_copies(spark, tmp_path):
    page = lambda k: "<p>copied</p><p>alike</p>" if k % 3 == 0 else f"<p>own {k}</p>" + ("<p>planted</p>" if k % 20 == 1 else "") + ("<p>few</p>" if k < 5 else "") + f"<p>end {k}</p>"
    rows = [(k, f"http://Big.example/{k}", page(k)) for k in range(600)] + [(601, None, None), (None, "no url", ""), (602, "http://small.example", page(0)), (602, "http://small.example", page(0))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = lines.op5_line_dedup(spark, str(tmp_path))
    names = sorted(got.columns)
    found = {r["page_id"]: r["text"] for r in got.collect()}
    assert found[0] == "copied\nalike" and found[1] == "own 1\nfew\nend 1" and found[602] == "copied\nalike" and found[601] == ""
    assert all("planted" not in t for t in found.values()) and found[4] == "own 4\nfew\nend 4"
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = c.execute(f"select {', '.join(names)} from ({lines.OP5_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want)) and len(want) == len(rows)


def test_stage_counts_copies_of_a_text_once(spark):
    rows = [(k, "copied\nalike" if k % 3 == 0 else f"own {k}\nmenu", "h") for k in range(60)] + [(k, "copied\nalike", "small") for k in range(100, 103)]
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.line_dedup(spark, docs(spark, rows), "").collect()}
    assert got == {k: t.replace("\nmenu", "") for k, t, _ in rows}


def test_mix(spark):
    rows = [(k, "w " * (k % 7 + 1), f"s{k % 4}" if k % 4 else None) for k in range(200)] + odd_rows()
    got = mixing.mix(docs(spark, rows)).collect()
    again = mixing.mix(docs(spark, rows).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    taken, target, largest = {}, {}, {}
    for r in got:
        s = r["source"]
        assert r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[s], target[s], largest[s] = taken.get(s, 0) + r["taken"], r["target"], max(largest.get(s, 0), r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken)
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6


def brute_vectors(n=400):
    r = np.random.default_rng(4)
    v = r.standard_normal((n, 16))
    v[100:150] = v[0] + 0.05 * r.standard_normal((50, 16))
    v[150:160] = v[1]
    return v


def test_itq(spark):
    v = brute_vectors()
    rows = [(k, [float(x) for x in v[k]], 0) for k in range(len(v))] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [1.0] * 16, None), (903, [float("nan")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in itq.linked_vectors(df, block=64).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= itq.COSINE
    assert all(got[k][0] == near[k].sum() - 1 for k in range(len(v)))  # all links, at this size
    assert all(got[k] == (0, k) for k in (900, 901, 902, 903)) and got[155][1] == 1 and got[120][1] == 0


def test_knn(spark):
    v = brute_vectors(600)
    df = spark.createDataFrame([(k, [float(x) for x in v[k]]) for k in range(600)] + [(5000, None)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = knn.nearest(df, F.col("vec_id") % 50 == 0).collect()
    hits = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.lexsort((np.arange(600), -s))[:5]) & {r["id"] for r in got if r["query_id"] == q})
    assert hits >= 0.98 * 60 and all(abs(r["score"] - u[r["query_id"]] @ u[r["id"]]) < 1e-12 for r in got)


def test_language(spark):
    d = docs(spark, [(k, "the cat and the dog of the house" if k % 2 else "le chat et le chien de la maison", "en" if k % 2 else "fr") for k in range(40)])
    profiles = langid.learn_profiles(d, "doc_id", "text", "source")
    got = {r["id"]: r["lang_pred"] for r in langid.identify(d.unionByName(docs(spark, [(90, None, "x"), (91, "123", "x")])), profiles).collect()}
    assert got[1] == "en" and got[2] == "fr" and got[90] == got[91] == "und"


def test_toxicity_learns():
    r = random.Random(6)
    make = lambda bad: " ".join("".join(r.choice("abcdef") for _ in range(4)) for _ in range(60)) + (" vile and " * 3 if bad else " ") + "end"
    y = np.array([k % 2 for k in range(1500)])  # with a few hundred texts the network is weak, as the README says
    p, vocab = toxicity.train([make(k) for k in y], y)
    new = [make(k % 2) for k in range(100)]  # texts that it has not seen
    out = toxicity.document_logits(toxicity.Words(p, vocab), [*new, "", None])
    score = 1 / (1 + np.exp(-(p["scale"][0] * out + p["scale"][1])))
    right = (score[:100] >= toxicity.THRESHOLD) == (np.arange(100) % 2 == 1)
    assert right.mean() >= 0.95 and np.isfinite(score).all() and toxicity.window_starts(100)[-1] + toxicity.WINDOW >= 100


def test_odd_and_empty_tables(spark):
    spec = bpe.vocabulary("byte_bpe_50k.json")
    model = toxicity.train(["a b", "c d"], np.array([0, 0]))
    for rows in (odd_rows(), []):
        d = docs(spark, rows)
        assert bpe.digests(d, spec).count() == len(rows)
        assert simhash.simhash_components(d).count() == len(rows)
        assert mixing.mix(d).count() == len(rows)
        assert toxicity.score(d, model).count() == len(rows)
        assert langid.identify(d, {}).count() == len(rows)
        assert lines.drop_boilerplate(d, F.col("source"), F.col("text")).count() == len(rows)
        substrings.repeated_spans(d).collect()
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert itq.linked_vectors(none).count() == 0 and knn.nearest(none, F.col("vec_id") % 50 == 0).count() == 0
