"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as the vector of a known word beside the mean of its hashed character trigram vectors. A window of
consecutive words runs through a forward and a backward GRU; attention pools the states to one logit. Windows
overlap by a third and cover the whole text; a document's logit is that of its worst window, and a logistic fit on
the training documents turns it into the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, free_names, held_in_worker, held_out

WINDOW, STRIDE = 24, 16
WORDS, GRAMS = 20_000, 1 << 12
WIDTH, HIDDEN = 8, 8
SAMPLE = {1: 1200, 0: 4000}
THRESHOLD = 0.3
#: The sample's texts are of at most so many characters; longer ones are scored whole but do not train.
SAMPLE_CHARS = 40_000
#: Training: passes over WINDOWS random windows of each sampled text, then passes over its worst one (clean texts: three)
#: of all its windows; the least number of steps before; the share of words hidden.
EARLY, LATE, WINDOWS, LEAST_STEPS, HIDE = 4, 5, 6, 150, 0.3
MEMORY = 150_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """The text's words in lower case."""
    return _WORD.findall((text or "").lower())


def vocabulary(split: list[list[str]]) -> dict[str, int]:
    """Number, from 1, of each word that at least three texts hold, the WORDS most widespread; ties by the word."""
    spread = Counter(w for s in split for w in set(s))
    known = sorted((w for w, n in spread.items() if n >= 3), key=lambda w: (-spread[w], w))[:WORDS]
    return {w: k + 1 for k, w in enumerate(known)}


def contrast(split: list[list[str]], toxic: np.ndarray, vocab: dict[str, int]) -> np.ndarray:
    """By word number, how far the share of toxic texts with the word exceeds that of the others: its excess over two
    standard errors. The network starts from it, so that a few labelled texts point it to the words that matter."""
    n = np.zeros((2, len(vocab) + 1))
    for own, y in zip(split, toxic):
        n[y, [vocab[w] for w in set(own) if w in vocab]] += 1
    all_of = np.maximum(1, np.bincount(toxic, minlength=2))
    p = (n.sum(axis=0) + 1) / (all_of.sum() + 2)
    z = (n[1] / all_of[1] - n[0] / all_of[0]) / np.sqrt(p * (1 - p) * (1 / all_of).sum())
    return (np.sign(z) * np.maximum(0, np.abs(z) - 2)).astype(np.float32)


def features(words: list[str], vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word, 0 if unknown; buckets of all their byte trigrams; end of each word's trigrams)."""
    coded = [f"<{w}>".encode("utf-8", "replace") for w in words]
    numbers = np.fromiter((vocab.get(w, 0) for w in words), np.int64, len(words))
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    three = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761) >> np.uint32(32 - 12)
    inside = np.ones(len(data), bool)
    ends = np.cumsum(lengths)
    inside[ends - 1] = inside[ends - 2] = False
    return numbers, three[inside[:-2]].astype(np.int64), np.cumsum(lengths - 2)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def initial(known: int, seed: int = 1) -> dict[str, np.ndarray]:
    r, h, e = np.random.default_rng(seed), HIDDEN, WIDTH
    n = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    p = {"word": n(known + 1, e, scale=0.1), "gram": n(GRAMS, e, scale=0.1), "out": n(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {f"W{d}": n(2 * e, 3 * h, scale=0.4), f"c{d}": np.zeros(3 * h, np.float32), f"U{d}": n(h, 3 * h, scale=0.3)}
    return p | {"att": n(2 * h, scale=0.3)}


def _gates(p, d: str, x: np.ndarray, h: np.ndarray):
    """One step: x holds the input's part of (update, reset, new) gates."""
    k = HIDDEN
    u = h @ p[f"U{d}"]
    zr = _sigmoid(x[:, : 2 * k] + u[:, : 2 * k])
    z, r = zr[:, :k], zr[:, k:]
    n = np.tanh(x[:, 2 * k :] + r * u[:, 2 * k :])
    return n + z * (h - n), z, r, n, u[:, 2 * k :]


def _run(p, xf: np.ndarray, xb: np.ndarray, live: np.ndarray, keep: bool = False):
    """Logits of windows; inputs are (steps, windows, 3 * HIDDEN), live is (steps, windows)."""
    steps, n = live.shape
    states, tape = np.empty((steps, n, 2 * HIDDEN), np.float32), []
    for d, x, order, at in (("f", xf, range(steps), slice(0, HIDDEN)), ("b", xb, range(steps - 1, -1, -1), slice(HIDDEN, None))):
        h = np.zeros((n, HIDDEN), np.float32)
        for t in order:
            new, z, r, c, u = _gates(p, d, x[t], h)
            new = np.where(live[t][:, None], new, h)
            if keep:
                tape.append((d, t, h, z, r, c, u))
            states[t, :, at] = h = new
    energy = np.where(live, states @ p["att"], np.float32(-1e9))
    energy -= energy.max(axis=0)
    weight = np.exp(energy)
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    return pooled @ p["out"] + p["bias"], (states, weight, pooled, tape)


def _inputs(p, at_word: np.ndarray, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Vectors of words: word vector beside the mean of its trigram vectors."""
    starts = np.concatenate([[0], ends[:-1]])
    chars = np.add.reduceat(p["gram"][grams], starts, axis=0) / (ends - starts)[:, None]
    return np.concatenate([p["word"][at_word], chars.astype(np.float32)], axis=1)


class Words:
    """Rows of gate inputs for words; row 0 stands for no word."""

    def __init__(self, p: dict[str, np.ndarray], vocab: dict[str, int]):
        self.p, self.vocab, self.at = p, vocab, {}
        self.f = np.zeros((1, 3 * HIDDEN), np.float32)
        self.b = np.zeros((1, 3 * HIDDEN), np.float32)
        self.n = 1

    def look_up(self, words: list[str]) -> np.ndarray:
        at = self.at
        new = [w for w in dict.fromkeys(words) if w not in at]
        if new:
            if len(at) + len(new) > MEMORY:
                at.clear()
                self.n, new = 1, list(dict.fromkeys(words))
            for k in range(0, len(new), 20_000):
                self._learn(new[k : k + 20_000])
        return np.fromiter(map(at.__getitem__, words), np.int32, len(words))

    def _learn(self, new: list[str]) -> None:
        x = _inputs(self.p, *features(new, self.vocab))
        need = self.n + len(new)
        if need > len(self.f):
            room = np.zeros((max(need, 2 * len(self.f)) - len(self.f), 3 * HIDDEN), np.float32)
            self.f, self.b = np.concatenate([self.f, room]), np.concatenate([self.b, room])
        self.f[self.n : need] = x @ self.p["Wf"] + self.p["cf"]
        self.b[self.n : need] = x @ self.p["Wb"] + self.p["cb"]
        self.at.update(zip(new, range(self.n, need)))
        self.n = need


def window_starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover n words; one window for a short text."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def window_rows(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words each, laid end to end: (document, first word, end of the document) by window."""
    ends = np.cumsum(counts)
    per = [window_starts(n) for n in counts]
    doc = np.repeat(np.arange(len(counts)), [len(x) for x in per])
    first = np.concatenate(per) + np.repeat(ends - counts, [len(x) for x in per])
    return doc, first, ends[doc]


def run_windows(p, f: np.ndarray, b: np.ndarray, flat: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Logit of each window (first word, end of its document) over the word rows ``flat``."""
    flat = np.concatenate([flat, np.zeros(WINDOW, np.int32)])
    logits, span = np.empty(len(first), np.float32), np.arange(WINDOW)[:, None]
    for k in range(0, len(first), 2048):
        at = first[k : k + 2048] + span
        live = at < end[k : k + 2048]
        ids = np.where(live, flat[at], 0)
        live[0] = True  # a text without words is one window of the empty input
        logits[k : k + 2048] = _run(p, f[ids], b[ids], live)[0]
    return logits


def window_logits(words: Words, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document of each window, logit of each window)."""
    split = [words_of(t) for t in texts]
    flat = words.look_up([w for s in split for w in s])
    doc, first, end = window_rows([len(s) for s in split])
    return doc, run_windows(words.p, words.f, words.b, flat, first, end)


def document_logits(words: Words, texts: list[str | None]) -> np.ndarray:
    """The worst window's logit of each text."""
    out = np.empty(len(texts), np.float32)
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < 400_000):
            size += len(texts[to] or "")
            to += 1
        doc, logits = window_logits(words, texts[at:to])
        np.maximum.at(part := np.full(to - at, -np.inf, np.float32), doc, logits)
        out[at:to], at = part, to
    return out


def _gradients(p, ids: np.ndarray, live: np.ndarray, x: np.ndarray, hidden: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Gradients of the weighted logistic loss; ids index the rows of word vectors x. Returns (gradients, of x).

    Rows marked ``hidden`` stand for no word: their gate inputs are zero here as in ``Words``, and they teach nothing.
    """
    k = HIDDEN
    xf, xb = x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]
    xf[hidden] = xb[hidden] = 0
    logits, (states, att, pooled, tape) = _run(p, xf[ids], xb[ids], live, keep=True)
    dl = ((_sigmoid(logits) - y) * weight / len(y)).astype(np.float32)
    g = {n: np.zeros_like(v) for n, v in p.items() if n not in ("word", "gram")}
    g["out"], g["bias"] = pooled.T @ dl, dl.sum(keepdims=True)
    dp = dl[:, None] * p["out"]
    dw = np.einsum("nh,tnh->tn", dp, states)
    de = att * (dw - (att * dw).sum(axis=0))
    g["att"] = np.einsum("tn,tnh->h", de, states)
    ds = att[:, :, None] * dp + de[:, :, None] * p["att"]
    dx = {"f": np.zeros((len(x), 3 * k), np.float32), "b": np.zeros((len(x), 3 * k), np.float32)}
    dh = {"f": np.zeros((ids.shape[1], k), np.float32), "b": np.zeros((ids.shape[1], k), np.float32)}
    for d, t, h, z, r, c, u in reversed(tape):
        on = live[t][:, None]
        whole = dh[d] + ds[t][:, :k] if d == "f" else dh[d] + ds[t][:, k:]
        own = np.where(on, whole, 0)
        dc = own * (1 - z) * (1 - c * c)
        dz = own * (h - c) * z * (1 - z)
        dr = dc * u * r * (1 - r)
        du = np.concatenate([dz, dr, dc * r], axis=1)
        g[f"U{d}"] += h.T @ du
        dh[d] = np.where(on, own * z + du @ p[f"U{d}"].T, whole)
        np.add.at(dx[d], ids[t], np.concatenate([dz, dr, dc], axis=1))
    dvec = np.zeros_like(x)
    for d in "fb":
        dx[d][hidden] = 0
        g[f"W{d}"], g[f"c{d}"] = x.T @ dx[d], dx[d].sum(axis=0)
        dvec += dx[d] @ p[f"W{d}"].T
    return g, dvec


class _Adam:
    def __init__(self, p, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({n: np.zeros_like(x) for n, x in p.items()} for _ in range(2))

    def step(self, p, g) -> None:
        self.t += 1
        for n, x in g.items():
            self.m[n] += 0.1 * (x - self.m[n])
            self.v[n] += 0.01 * (x * x - self.v[n])
            p[n] -= (self.rate * (self.m[n] / (1 - 0.9**self.t)) / (np.sqrt(self.v[n] / (1 - 0.99**self.t)) + 1e-7)).astype(np.float32)


def train(texts: list[str | None], toxic: np.ndarray, seed: int = 1) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """(parameters, vocabulary) learned from texts with 0/1 marks; ``scale`` maps a document's worst logit to its score.

    First passes let a few windows of every kind speak for their document; later ones take each document's worst
    windows, which is what the score looks at. A fifth of the texts is kept back for the logistic fit of ``scale``.
    """
    split = [words_of(t) for t in texts]
    vocab = vocabulary(split)
    r, p = np.random.default_rng(seed), initial(len(vocab), seed)
    p["word"][0] = 0
    if not len(texts) or toxic.min() == toxic.max():
        rate = float(np.clip(np.mean(toxic) if len(texts) else 0.0, 0.001, 0.999))
        return p | {"scale": np.array([0.0, np.log(rate / (1 - rate))], np.float32)}, vocab
    names = list(dict.fromkeys(w for s in split for w in s))
    row = {w: k + 1 for k, w in enumerate(names)}
    flat = np.array([row[w] for s in split for w in s], np.int32)
    longer = np.concatenate([flat, np.zeros(WINDOW, np.int32)])
    word_of, gram_of, gram_end = features(["", *names], vocab)  # row 0, the empty word, stands for no word
    gram_start = np.concatenate([[0], gram_end[:-1]])
    gram_of = np.concatenate([gram_of, [0]])
    if gram_end[0] == 0:
        gram_end, gram_start = gram_end + 1, gram_start + 1
        gram_start[0], gram_of = 0, np.concatenate([[0], gram_of])
    doc, first, end = window_rows([len(s) for s in split])
    back = (np.arange(len(texts)) % 5 == 4) & (len(texts) >= 50)
    p["word"][:, 0] += 0.5 * contrast([x for x, b in zip(split, back) if not b], toxic[~back], vocab)
    p["word"][0] = 0
    span = np.arange(WINDOW)[:, None]
    learn_on = ~back[doc]
    n1, n0 = max(1, (toxic[~back] == 1).sum()), max(1, (toxic[~back] == 0).sum())
    share = np.array([0.5 / n0, 0.5 / n1], np.float32) * (n0 + n1)
    adam = _Adam(p, 0.01)

    def epoch(chosen: np.ndarray) -> None:
        chosen = r.permutation(chosen)
        for k in range(0, len(chosen), 256):
            c = chosen[k : k + 256]
            at = first[c] + span
            real = at < end[c]
            live = real.copy()
            live[0] = True
            # three tenths of the words are hidden, so that no single rare word decides
            rows, ids = np.unique(np.where(real & (r.random(real.shape) > HIDE), longer[at], 0), return_inverse=True)
            ids = ids.reshape(live.shape)
            lengths = gram_end[rows] - gram_start[rows]
            grams = gram_of[np.repeat(gram_start[rows] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
            x = _inputs(p, word_of[rows], grams, np.cumsum(lengths))
            y = toxic[doc[c]]
            g, dx = _gradients(p, ids, live, x, rows == 0, y.astype(np.float32), share[y])
            g["word"], g["gram"] = 2e-6 * p["word"], 2e-6 * p["gram"]
            np.add.at(g["word"], word_of[rows], dx[:, :WIDTH])
            g["word"][0] = 0
            np.add.at(g["gram"], grams, np.repeat(dx[:, WIDTH:] / lengths[:, None], lengths, axis=0).astype(np.float32))
            adam.step(p, g)

    def all_logits() -> np.ndarray:
        x = _inputs(p, word_of, gram_of[: gram_end[-1]], gram_end)
        f, b = x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]
        f[0] = b[0] = 0
        return run_windows(p, f, b, flat, first, end)

    nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
    passes = -(-LEAST_STEPS * 256 // int((learn_on & (nth < WINDOWS)).sum()))  # few texts are gone over more often
    for _ in range(max(EARLY, passes)):
        mixed = np.argsort(r.random(len(doc)) + doc, kind="stable")[nth < WINDOWS]
        epoch(mixed[learn_on[mixed]])
    adam.rate = 0.004
    for _ in range(LATE):
        order = np.lexsort((-all_logits(), doc))
        worst = order[(nth < 1) | ((nth < 3) & (toxic[doc] == 0))]
        epoch(worst[learn_on[worst]])
    logits = all_logits()
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, doc, logits)
    fit = back if back.any() and toxic[back].min() < toxic[back].max() else np.ones(len(texts), bool)
    return p | {"scale": np.array(_logistic(worst[fit], toxic[fit]), np.float32)}, vocab


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the slightly regularised fit of sigmoid(a x + b) to y, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = q * (1 - q) + 1e-6
        grad = np.array([((q - y) * x).sum() + 0.1 * (a - 1), (q - y).sum()])
        hess = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    return a, b


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: dict[int, int] = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """Train on about ``sample`` labelled documents of each class (toxic 1 and 0), whole texts; held-out ids teach nothing.

    Only texts of at most ``chars`` characters are in the sample, and of rows that repeat an id the least text, so that
    what comes to the driver is bounded. An id with both labels counts as toxic.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(known, "toxic", "doc_id", sample, 3)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where(F.length("text") <= chars).join(F.broadcast(chosen), "doc_id")
    got = sorted((r["doc_id"], r["text"], int(r["toxic"])) for r in rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect())
    return train([t for _, t, _ in got], np.array([y for *_, y in got], np.int64))


def score(docs: DataFrame, model: tuple[dict[str, np.ndarray], dict[str, int]], id_col: str | None = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col (without one: all columns of ``docs``), score (0 to 1) and predicted (1 if score >= threshold).

    Null and empty texts score as a window without words, very long ones by all their windows. Repeated rows stay; an
    empty table gives an empty result. Without an ``id_col``, columns of ``docs`` named score or predicted are replaced.
    """
    others = [c for c in docs.columns if c not in ("score", "predicted")] if id_col is None else [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*[F.col(f"`{c}`") for c in others], F.col(text_col).cast("string").alias(free_names(docs, "_text")[0]))
    plain = T.StringType() == docs.schema[text_col].dataType and text_col in others  # the text goes once, then
    at = others.index(text_col) if plain else len(others)
    base = base.select(*base.columns[: len(others) + (not plain)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, vocab = shared.value
        key = hash(p["word"].tobytes() + p["out"].tobytes())
        words = held_in_worker("toxicity", key, lambda: Words(p, vocab))
        a, b = p["scale"].astype(np.float64)
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, len(b), 1000)):
            logits = document_logits(words, batch.column(at).to_pylist()).astype(np.float64)
            got = 1 / (1 + np.exp(-np.clip(a * logits + b, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(others))), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=[*others, "score", "predicted"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields[: len(others)], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    params = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, params)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those predicted toxic; columns as they were, whatever their names. Cases as in ``learn`` and ``score``."""
    params = learn(docs, labels, id_col, text_col)
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    kept = score(numbered, params, id_col=None, text_col=f"c{docs.columns.index(text_col)}").where("predicted = 0")
    return kept.select(*numbered.columns).toDF(*docs.columns)
