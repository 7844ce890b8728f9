"""Operators without SQL against plain Python versions of the same rules."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sieveline.llm import bpe, itq, knn, langid, lines, mixing, simhash, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, letters="abcdefghijklmnop", size=6):
    return " ".join("".join(r.choice(letters) for _ in range(size)) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], DOCS)


# op1


def plain_spans(rows, least):
    """Copies of chunks, grown step by step on the bytes themselves."""
    texts, chunks = {i: (t or "").encode() for i, t in rows}, []
    for i, data in texts.items():
        s = 0
        for e in substrings.cuts(data).tolist():
            chunks.append((i, s, e, data[s:e]))
            s = e
    first = {}
    for i, s, _, d in sorted(chunks):
        first.setdefault(d, (i, s))
    copies = [(i, s, e, *first[d]) for i, s, e, d in sorted(chunks) if first[d] != (i, s)]
    step, out = substrings.STEP, []
    for n, (i, s, e, fi, fs) in enumerate(copies):
        own, other, fe = texts[i], texts[fi], fs + e - s
        right = left = 0
        while right < step * substrings.STEPS and len(x := own[e + right : e + right + step]) == step and x == other[fe + right : fe + right + step]:
            right += step
        while left < step * substrings.STEPS and min(s, fs) >= left + step and own[s - left - step : s - left] == other[fs - left - step : fs - left]:
            left += step
        if n + 1 < len(copies) and copies[n + 1][0] == i:
            right = min(right, copies[n + 1][1] - e)
        if i == fi:
            left = min(left, max(s - fs - (e - s), 0))
        if out and out[-1][0] == i:
            left = min(left, s - out[-1][2])
        if out and out[-1][0] == i and out[-1][2] == s - left:
            out[-1][2] = e + right
            out[-1][3] += 1
        else:
            out.append([i, s - left, e + right, 1, fi, fs - left])
    return sorted((i, s, e - s, n, fi, fs) for i, s, e, n, fi, fs in out if e - s >= least)


def test_substrings_equal_brute_force(spark):
    r = random.Random(4)
    shared = [prose(r, n) for n in (60, 30, 200)]
    rows = [(k, " ".join(prose(r, r.randint(0, 80)) + (" " + r.choice(shared) if r.random() < 0.4 else "") for _ in range(3))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 20_000), (103, shared[2] + "x" * 20_000), (104, rows[5][1])]
    got = substrings.repeated_spans(documents(spark, [(i, t, "s") for i, t in rows]), min_bytes=60)
    assert sorted((x["id"], x["start"], x["n_bytes"], x["n_chunks"], x["first_id"], x["first_start"]) for x in got.collect()) == plain_spans(rows, 60)


def test_substrings_catch_planted_passages(spark):
    """Passages of 51 to 120 words in texts of other words: the rate that the README gives."""
    r, rows, n = random.Random(14), [], 150
    for k in range(n):
        passage = prose(r, r.randint(51, 120))
        for c in range(2):
            rows.append((2 * k + c, f"{prose(r, r.randint(5, 60))} {passage} {prose(r, r.randint(5, 60))}", "s"))
    got = {x["id"] for x in substrings.repeated_spans(documents(spark, rows)).collect()}
    assert len(got) >= 0.93 * n and all(i % 2 for i in got)


# op4


def plain_logit(p, vocab, text):
    """Score of a text window by window, word by word."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    words, k = toxicity.words_of(text), toxicity.HIDDEN

    def vector(w):
        data = f"<{w}>".encode()
        grams = [((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32) >> 20 for i in range(len(data) - 2)]
        return np.concatenate([p["word"][vocab.get(w, 0)], np.mean([p["gram"][g] for g in grams], axis=0)]).astype(float)

    best = -math.inf
    for s in range(0, max(1, len(words) - 8), 16):
        own = [vector(w) for w in words[s : s + 24]]
        inputs = {d: [x @ p[f"W{d}"] + p[f"c{d}"] for x in own] or [np.zeros(3 * k)] for d in "fb"}
        states = {}
        for d in "fb":
            h, seq = np.zeros(k), []
            for x in inputs[d] if d == "f" else inputs[d][::-1]:
                u = h @ p[f"U{d}"]
                z, r = sig(x[:k] + u[:k]), sig(x[k : 2 * k] + u[k : 2 * k])
                c = np.tanh(x[2 * k :] + r * u[2 * k :])
                h = (1 - z) * c + z * h
                seq.append(h)
            states[d] = seq if d == "f" else seq[::-1]
        both = np.array([np.concatenate(x) for x in zip(states["f"], states["b"])])
        e = np.exp(both @ p["att"])
        best = max(best, float((e / e.sum()) @ both @ p["out"] + p["bias"][0]))
    return best


def toxic_text(r, bad):
    words = prose(r, 60, "abcdef", 4).split()
    for _ in range(3 * bad):
        words[r.randrange(60)] = r.choice(["vile", "scum", "trash"])
    return " ".join(words)


def test_toxicity_equals_brute_force(spark):
    r = random.Random(6)
    y = np.array([k % 2 for k in range(80)])
    model = toxicity.train([toxic_text(r, k) for k in y], y)
    texts = [toxic_text(r, k % 2) for k in range(20)] + ["", None, "one", "vile " * 2000, "日本 vile ñ", prose(r, 5000)]
    got = {x["doc_id"]: x["score"] for x in toxicity.score(documents(spark, [(k, t, "s") for k, t in enumerate(texts)]), model).collect()}
    a, b = model[0]["scale"].astype(float)
    for k, t in enumerate(texts):
        assert abs(got[k] - 1 / (1 + math.exp(-(a * plain_logit(*model, t) + b)))) < 1e-4


def test_gradients_equal_finite_differences():
    r = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(5).items()}
    rows, steps, windows = 9, 7, 6
    x = r.standard_normal((rows, 2 * toxicity.WIDTH))
    hidden = np.arange(rows) == 4  # wherever the hidden word's row lies
    ids, live = r.integers(0, rows, (steps, windows)), r.random((steps, windows)) < 0.8
    live[0] = True
    y, weight = r.integers(0, 2, windows).astype(float), r.random(windows) + 0.5

    def loss():
        f, b = x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]
        f[hidden] = b[hidden] = 0
        logits = exact_run(p, f[ids], b[ids], live)
        return float((weight * (np.logaddexp(0, logits) - y * logits)).sum() / windows)

    def exact_run(p, f, b, live):
        k, out = toxicity.HIDDEN, []
        sig = lambda v: 1 / (1 + np.exp(-v))
        for d, xs, order in (("f", f, range(steps)), ("b", b, range(steps - 1, -1, -1))):
            h, seq = np.zeros((windows, k)), np.zeros((steps, windows, k))
            for t in order:
                u = h @ p[f"U{d}"]
                z, g = sig(xs[t][:, :k] + u[:, :k]), sig(xs[t][:, k : 2 * k] + u[:, k : 2 * k])
                c = np.tanh(xs[t][:, 2 * k :] + g * u[:, 2 * k :])
                h = np.where(live[t][:, None], (1 - z) * c + z * h, h)
                seq[t] = h
            out.append(seq)
        both = np.concatenate(out, axis=2)
        e = np.where(live, both @ p["att"], -1e9)
        w = np.exp(e - e.max(axis=0))
        return np.einsum("tn,tnh->nh", w / w.sum(axis=0), both) @ p["out"] + p["bias"]

    g, dx = toxicity._gradients(p, ids, live, x, hidden, y, weight)
    for name, values, got in [*((n, p[n], g[n]) for n in g), ("x", x, dx)]:
        for at in r.choice(values.size, min(values.size, 12), replace=False):
            spot = np.unravel_index(at, values.shape)
            was = values[spot]
            values[spot] = was + 1e-5
            up = loss()
            values[spot] = was - 1e-5
            down = loss()
            values[spot] = was
            assert abs((up - down) / 2e-5 - got[spot]) < 2e-4 * max(1, abs(got[spot])), (name, spot)


def test_toxicity_with_few_labels():
    """Some forty toxic texts suffice for words that they share."""
    r = random.Random(8)
    y = np.array([int(k % 8 == 0) for k in range(320)])
    p, vocab = toxicity.train([toxic_text(r, k) for k in y], y)
    logits = toxicity.document_logits(toxicity.Words(p, vocab), [toxic_text(r, k % 2) for k in range(200)])
    said = 1 / (1 + np.exp(-(p["scale"][0] * logits + p["scale"][1]))) >= toxicity.THRESHOLD
    right = said == (np.arange(200) % 2 == 1)
    assert right.mean() >= 0.9


def test_toxicity_sample_is_bounded(spark):
    r = random.Random(9)
    rows = [(k, toxic_text(r, k % 2), "s") for k in range(60)] + [(3, "another text of this id", "s"), (61, "vile " * 20_000, "s")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(62)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    seen = []
    train = toxicity.train
    try:
        toxicity.train = lambda texts, y: seen.append((texts, y)) or train(texts, y)
        toxicity.learn(documents(spark, rows), labels)
    finally:
        toxicity.train = train
    (texts, y), held = seen[0], {k for k in range(62) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert len(texts) == len(set(range(61)) - held - {60}) and max(map(len, texts)) <= toxicity.SAMPLE_CHARS


# op9


def plain_targets(sizes, weights, share, ceiling):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_ = share * sum(sizes.values()), set(names)
    target = {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= ceiling * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = float(ceiling * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("kind", ["mixed", "digits", "copies"])
def test_mix_equals_brute_force(spark, kind):
    r = random.Random(11)
    text = {"mixed": lambda: prose(r, r.randint(0, 40)), "digits": lambda: " ".join(str(r.randint(0, 9)) for _ in range(r.randint(1, 30))), "copies": lambda: "the same text"}[kind]
    rows = [(k, text(), None if k % 11 == 0 else f"s{k % 5 if k % 3 else 0}") for k in range(3000)]
    got = mixing.mix(documents(spark, rows)).collect()
    keyed = {x["doc_id"]: x["key"] for x in documents(spark, rows).select("doc_id", mixing.sampling_key(F.col("doc_id"), F.col("text"), 11, mixing.quality_weight).alias("key")).collect()}
    sizes, size = Counter(), {i: len((t or "").split()) for i, t, _ in rows}
    for i, _, s in rows:
        sizes[s] += size[i]
    targets = plain_targets(sizes, mixing.WEIGHTS, 1.5, 2.0)
    want = {}
    for s in sizes:
        epochs = int(targets[s] // sizes[s]) if sizes[s] else 0
        rest, before = targets[s] - epochs * sizes[s], 0
        for i in sorted((i for i, _, x in rows if x == s), key=keyed.get):
            want[i] = size[i] * (epochs + (rest > 0 and before + size[i] / 2 <= rest))
            before += size[i]
    assert {x["id"]: x["taken"] for x in got} == want
    assert all(abs(x["target"] - targets[x["source"]]) < 1e-6 for x in got)
    taken = Counter(x["doc_id"] for x in mixing.take_mix(documents(spark, rows)).collect())
    assert taken == {i: t // size[i] for i, t in want.items() if t}


# op10


def plain_profile(texts, most):
    counts = Counter()
    for t in texts:
        s = "_".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split())
        if s:
            s = f"_{s}_"
            counts.update(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n] != "_")
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:most]


def test_language_equals_brute_force(spark):
    r = random.Random(13)
    letters = {"aa": "abcdeé", "bb": "cdefgß", "cc": "漢字かな"}
    rows = [(k, prose(r, r.randint(1, 30), letters[n], 3), n, "s", 0) for k in range(90) for n in [list(letters)[k % 3]]]
    rows += [(200, None, "aa", "s", 0), (201, "12 !", "bb", "s", 0), (202, "aB" * 30_000, None, "s", 0), (203, "", None, "s", 0)]
    d = spark.createDataFrame(rows, DOCS)
    profiles = langid.learn_profiles(d, "doc_id", "text", "lang", length=50)
    plain = {n: plain_profile([t for _, t, x, *_ in rows if x == n], 50) for n in letters}
    assert {n: ["".join(map(chr, [c >> 42 & 0x1FFFFF, c >> 21 & 0x1FFFFF, c & 0x1FFFFF])).strip("\0") for c in p.tolist()] for n, p in profiles.items()} == plain
    for x in langid.identify(d, profiles, length=50).collect():
        own = plain_profile([rows[[i for i, *_ in rows].index(x["id"])][1]], 50)
        cost = {n: sum(abs(p.index(g) - k) if g in p else 50 for k, g in enumerate(own)) for n, p in plain.items()}
        best = min(sorted(cost), key=cost.get) if own else "und"
        assert x["lang_pred"] == best and abs(x["score"] - (1 - cost[best] / (50 * len(own)) if own else 0)) < 1e-12


# pipeline


def shingles(text, n=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, against plain versions of the same rules."""
    r, rows = random.Random(21), []
    for k in range(240):
        rows.append([k, toxic_text(r, k % 6 == 0) + "\n" + prose(r, 40), f"s{k % 3}"])
        if k % 4 == 0:
            rows[-1][1] += "\nread more on our site"
    for k in range(240, 260):  # exact and near copies
        words = rows[k - 200][1].split(" ")
        if k % 2:
            words[50] = "changed"
        rows.append([k, " ".join(words), rows[k - 200][2]])
    rows += [[300, None, "s0"], [301, "", None], [302, "z " * 9000, "s1"]]
    documents(spark, rows).coalesce(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    known = [(k, int(k % 6 == 0)) for k in range(240)]
    spark.createDataFrame([(k, 1, y) for k, y in known], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf, docs, at = f"file://{tmp_path}", spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        at[name] = docs.collect()

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    text = {i: t for i, t, _ in rows}
    learned = [(i, y) for i, y in known if not held(i)]
    p, vocab = toxicity.train([text[i] for i, _ in learned], np.array([y for _, y in learned]))
    score = lambda t: 1 / (1 + math.exp(-(p["scale"][0] * plain_logit(p, vocab, t) + p["scale"][1])))
    kept = [(i, t, s) for i, t, s in rows if score(t) < toxicity.THRESHOLD]
    assert sorted(x["doc_id"] for x in at["toxicity"]) == [i for i, *_ in kept]
    caught = {i for i, y in known if y} - {i for i, *_ in kept}
    # some thirty toxic texts to learn from
    assert len(caught) >= 38 and len({i for i, y in known if not y} - {i for i, *_ in kept}) <= 6

    trimmed = lambda t: [x.strip(" ") for x in (t or "").split("\n") if x.strip(" ")]
    pages, having = Counter(), Counter()
    for s in {s for *_, s in kept}:
        alike = {tuple(trimmed(t)) for _, t, x in kept if x == s}
        pages[s] = len(alike)
        for page in alike:
            having.update((s, line) for line in set(page))
    gone = {k for k, n in having.items() if any(n >= least and n > pages[k[0]] * share for share, least in lines.STAGE_RULES)}
    left = lambda t, s: "\n".join(x for x in trimmed(t) if (s, x) not in gone) if any((s, x) in gone for x in trimmed(t)) else t
    kept = [(i, left(t, s), s) for i, t, s in kept]
    assert gone and sorted((x["doc_id"], x["text"] or "", x["n_chars"]) for x in at["line_dedup"]) == sorted((i, t or "", None if t is None else len(t)) for i, t, _ in kept)

    sets = {i: shingles(t) for i, t, _ in kept}
    low = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    kept = [x for x in kept if low[x[0]] == x[0]]
    assert sorted(x["doc_id"] for x in at["simhash_near_dedup"]) == sorted(i for i, *_ in kept) and len(kept) < len(sets)

    size = {i: len((t or "").split()) for i, t, _ in kept}
    sizes = Counter()
    for i, _, s in kept:
        sizes[s] += size[i]
    targets = plain_targets(sizes, mixing.WEIGHTS, 1.5, 2.0)
    taken = Counter(x["doc_id"] for x in at["mixing"])
    for s in sizes:
        own = [i for i, _, x in kept if x == s]
        assert abs(sum(taken[i] * size[i] for i in own) - targets[s]) <= max(size[i] for i in own) / 2 + 1e-6
        assert {taken[i] for i in own if size[i]} <= {int(targets[s] // sizes[s]) + k for k in (0, 1)} if sizes[s] else True
    lib, final = Tokenizer.from_str(bpe.vocabulary("byte_bpe_50k.json")), {i: t for i, t, _ in kept}
    assert len(at["bpe"]) == sum(taken.values())
    for x in at["bpe"]:
        ids = lib.encode(final[x["doc_id"]], add_special_tokens=False).ids
        assert (x["n_tokens"], x["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# near-dedup in large candidate components, similarity search in blocks


@pytest.mark.parametrize("block", [8, 40])
def test_large_components_lose_no_link(spark, block):
    """Chains and families in one component of many blocks: the same groups as by all pairs."""
    r, sets, ids = random.Random(31), [], []
    chain = [r.getrandbits(63) for _ in range(100)]
    for k in range(60):  # each like the next only
        sets.append(sorted({*chain, *(r.getrandbits(63) for _ in range(0))}))
        chain = chain[8:] + [r.getrandbits(63) for _ in range(8)]
    base = [r.getrandbits(63) for _ in range(100)]
    for k in range(60):
        sets.append(sorted({*base[:97], r.getrandbits(63)}))
    for k in range(30):
        sets.append(sorted(r.getrandbits(63) for _ in range(100)))
    ids = [r.getrandbits(60) for _ in sets]
    rows = [(i, 1, 0, 0, len(s), bytearray(np.array(s, np.uint64).tobytes())) for i, s in zip(ids, sets)]
    members = spark.createDataFrame(rows, "id long, bucket long, f0 long, f1 long, n int, shingles binary")
    scratch = simhash.Scratch(spark, "t")
    links = simhash.confirmed_links(members, scratch, block)
    got = {x["node"]: x["root"] for x in simhash.connected_components(links, simhash.Scratch(spark, "t")).collect()}
    low, own = {i: i for i in ids}, {i: set(s) for i, s in zip(ids, sets)}
    for _ in range(80):
        before = dict(low)
        for a in ids:
            low[a] = min(low[b] for b in ids if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]))
        if low == before:
            break
    assert {i: got.get(i, i) for i in ids} == low and len(set(low.values())) == 32


def test_substrings_of_codes_meet(spark):
    """Planted pairs from the threshold on are found, in small and in wide tables."""
    r = np.random.default_rng(2)
    base = r.standard_normal((900, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn = r.standard_normal((300, 48))
    turn -= (turn * base[:300]).sum(axis=1, keepdims=True) * base[:300]
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    c = r.uniform(0.931, 0.96, (300, 1))
    v = np.concatenate([base, c * base[:300] + np.sqrt(1 - c * c) * turn])
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {x["id"]: x["n_links"] for x in itq.linked_vectors(df).collect()}
    assert sum(got[900 + k] >= 1 for k in range(300)) >= 0.98 * 300 and sum(got[k] for k in range(300, 900)) == 0
    for most in (2, 10**4, 10**6, 10**9):
        width, turns = itq.substrings(most)
        assert turns * (64 // width) >= 1 and 8 <= width <= 32


def test_every_pair_equals_brute_force(spark):
    r = np.random.default_rng(5)
    v = r.standard_normal((230, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(k, bytearray(x.astype(np.float32).tobytes())) for k, x in enumerate(v)]
    nodes = spark.createDataFrame(rows, "id long, vec binary")
    asked = nodes.where("id < 50").withColumnsRenamed({"id": "node", "vec": "qvec"})
    got = {}
    for x in knn.every_pair(asked, nodes, 230, 6, block=40).collect():
        got.setdefault(x["node"], []).append((-x["s"], x["id"]))
    h = v.astype(np.float32)
    for q in range(50):
        want = set(np.argsort(-(h @ h[q]), kind="stable")[:6].tolist())
        assert {i for _, i in sorted(got[q])[:6]} == want


@pytest.mark.parametrize("cosine", [0.999, 0.9999, 0.99999, 0.999999])
def test_nearest_among_near_copies(spark, cosine):
    """Clusters whose members are this alike: the nearest are told apart by exact scores."""
    r = np.random.default_rng(8)
    middle = r.standard_normal((6, 32))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    off = r.standard_normal((6, 150, 32))
    off -= (off * middle[:, None]).sum(axis=2, keepdims=True) * middle[:, None]
    off /= np.linalg.norm(off, axis=2, keepdims=True)
    v = (np.sqrt(cosine) * middle[:, None] + np.sqrt(1 - cosine) * off).reshape(900, 32)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for x in knn.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(x["query_id"], set()).add(x["id"])
    s = v @ v.T
    np.fill_diagonal(s, -2)
    hits = [len(got[q] & set(np.argsort(-s[q])[:5].tolist())) for q in range(0, 900, 50)]
    assert sum(hits) >= 0.95 * 5 * len(hits)


def test_hub_has_bounded_edges_and_tables_go(spark, monkeypatch):
    """A mean of all is among the best of each; its edges are bounded, its neighbours found; a failed walk leaves no table."""
    r = np.random.default_rng(6)
    v = np.concatenate([np.ones((1, 16)), np.ones((400, 16)) + 0.8 * r.standard_normal((400, 16))])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(knn, "MOST_BACKWARD", 4)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for x in knn.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(x["query_id"], set()).add(x["id"])
    assert sum(len(got[q] & set(np.argsort(-s[q])[:5].tolist())) for q in range(0, 401, 50)) >= 0.95 * 5 * 9
    scratch = knn.Scratch(spark, "t")
    write = scratch.write
    monkeypatch.setattr(scratch, "write", lambda df, name: 1 / 0 if name == "walk1" else write(df, name))
    with pytest.raises(ZeroDivisionError):
        knn.walk(spark.createDataFrame([(1, b"0", [2], [1.0], [False])], "a long, vec binary, b array<long>, s array<float>, fresh array<boolean>"), spark.createDataFrame([(1, b"0")], "node long, qvec binary"), scratch, 2, 4)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("walk_")]


def test_unlike_texts_in_reach_are_not_joined(spark):
    """Classes of one fingerprint and no common shingle, as large tables have by chance: no candidate link; near copies keep theirs."""
    r = np.random.default_rng(12)
    rows, family = [], r.integers(0, 1 << 63, 60).astype(np.uint64)
    for k in range(300):
        own = np.unique(np.concatenate([family[: 57 + k % 4], r.integers(0, 1 << 63, 3).astype(np.uint64)]) if k < 40 else r.integers(0, 1 << 63, 60).astype(np.uint64))
        rows.append((k, 5, 9, 60, bytearray(simhash.least_hashes(own))))
    nodes = spark.createDataFrame(rows, "cls long, f0 long, f1 long, n int, least_hashes binary")
    links = simhash.candidate_links(nodes, simhash.Scratch(spark, "t")).distinct()
    got = {x["node"]: x["root"] for x in simhash.connected_components(links, simhash.Scratch(spark, "t")).collect()}
    assert got == {k: 0 for k in range(40)}


def test_least_hashes_keep_pairs_of_the_threshold():
    """Of 3,000 pairs of similarity 0.8, small and large, none is told apart; of unlike ones nearly all."""
    r, kept, unlike = np.random.default_rng(13), 0, 0
    for k in range(3000):
        n = int(r.choice([20, 50, 200, 1000]))
        pool = r.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        both, odd = pool[: int(n * 0.8)], pool[int(n * 0.8) : n]
        least = np.frombuffer(b"".join(simhash.least_hashes(np.unique(x)) for x in (np.concatenate([both, odd[::2]]), np.concatenate([both, odd[1::2]]), pool[n:])), np.uint8).reshape(3, -1)
        at = lambda *i: np.array(i)
        kept += bool(simhash._share(least, at(0), at(1))[0])
        unlike += bool(simhash._share(least, at(0), at(2))[0])
    assert kept == 3000 and unlike == 0


def test_stage_tables_cover_the_radius():
    """At every size two fingerprints 34 bits apart agree on all bits of a table; tables of many texts have more bits."""
    r, before = np.random.default_rng(14), 0
    for total in (0, 10**4, 10**6, 10**7, 10**8, 10**9, 10**10):
        masks = simhash.stage_masks(total)
        for _ in range(300):
            bits = r.choice(128, simhash.STAGE_RADIUS, replace=False)
            apart = np.array([sum(1 << int(k % 64) for k in bits if k // 64 == half) for half in (0, 1)], np.uint64)
            assert ((masks & apart) == 0).all(axis=1).any()
        width = np.bitwise_count(masks).sum(axis=1)
        assert width.min() >= 3 and width.mean() >= before
        before = width.mean()


@pytest.mark.parametrize("block", [40, 65_536])
def test_every_pair_in_reach_is_a_candidate(spark, block):
    """Pairs 30 to 34 bits apart, of sizes as unlike as the similarity allows, are joined; pairs of 35 bits or unlike sizes are not."""
    r, rows, want = np.random.default_rng(15), [], {}
    signed = lambda x: x - 2**64 if x >> 63 else x
    for k in range(500):
        f, bits = [int(x) for x in r.integers(0, 2**64, 2, dtype=np.uint64)], r.choice(128, 30 + k % 6, replace=False)
        other = [f[half] ^ sum(1 << int(b % 64) for b in bits if b // 64 == half) for half in (0, 1)]
        n, least = int(r.choice([1, 5, 10, 40, 125, 3000])) * (1 + k % 2), bytearray(r.integers(1, 256, 32, dtype=np.uint8).tobytes())
        partner = -(-4 * n // 5) - (k % 7 == 0)
        rows += [(2 * k, signed(f[0]), signed(f[1]), n, least), (2 * k + 1, signed(other[0]), signed(other[1]), partner, least)]
        if len(bits) <= simhash.STAGE_RADIUS and partner >= 0.8 * n:
            want[2 * k] = want[2 * k + 1] = 2 * k
    nodes = spark.createDataFrame(rows, "cls long, f0 long, f1 long, n int, least_hashes binary")
    links = simhash.candidate_links(nodes, simhash.Scratch(spark, "t"), block).distinct()
    got = {x["node"]: x["root"] for x in simhash.connected_components(links, simhash.Scratch(spark, "t")).collect()}
    assert got == want and len(want) > 600
