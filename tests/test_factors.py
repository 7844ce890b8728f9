"""Sparse factors against dense ones, planted topics, and weights of odd texts."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import factors, learning
from sieveline.plans.registry import QUERIES
from sieveline.sources.shared import folder


def entries(spark, a):
    rows = [(int(i) * 1000, int(j) * 7 - 50, float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    df = spark.createDataFrame(rows, "row long, col long, w double").repartition(3)
    names = lambda c: df.select(F.col(c).alias("key")).distinct().withColumn("name", F.col("key").cast("string"))
    return df, names("row"), names("col")


def dense(vectors, keys):
    got = {r["key"]: r["vec"] for r in factors.arrays(vectors).collect()}
    zero = [0.0] * len(next(iter(got.values())))
    return np.array([got.get(k, zero) for k in keys])


@pytest.mark.parametrize("tile", [500_000, 150])
def test_singular_values_are_those_of_numpy(spark, tile):
    """A table of falling singular values, in one tile and in many."""
    r = np.random.default_rng(1)
    u, v = np.linalg.qr(r.standard_normal((60, 40)))[0], np.linalg.qr(r.standard_normal((45, 40)))[0]
    a = (u * np.logspace(1, -2, 40)) @ v.T
    a[np.abs(a) < 0.05] = 0
    df, _, cols = entries(spark, a)
    matrix = factors.Sparse(df, folder(spark), tile)
    assert (matrix.blocks > 1) == (tile == 150)
    s, rows, columns = factors.svd(matrix, cols, 10, folder(spark), rounds=3)
    want_u, want, want_v = np.linalg.svd(a)
    assert np.allclose(s, want[:10], rtol=1e-6)
    got = dense(rows, [k * 1000 for k in range(60)]) @ dense(columns, [k * 7 - 50 for k in range(45)]).T
    assert np.allclose(got, (want_u[:, :10] * want[:10]) @ want_v[:10], atol=1e-5)


def test_factors_reach_the_error_of_the_planted_ones(spark):
    r = np.random.default_rng(2)
    w, h = r.random((50, 3)) * (r.random((50, 3)) < 0.5), r.random((3, 30)) * (r.random((3, 30)) < 0.5)
    df, rows, cols = entries(spark, w @ h)
    gw, gh, errors = factors.nmf(factors.Sparse(df, folder(spark), 200), rows, cols, 3, folder(spark), rounds=10, tolerance=1e-9)
    assert all(a >= b - 1e-9 for a, b in zip(errors, errors[1:])) and errors[-1] < 2e-2 * ((w @ h) ** 2).sum()
    x = dense(gw, [k * 1000 for k in range(50)]) @ dense(gh, [k * 7 - 50 for k in range(30)]).T
    assert abs(((w @ h - x) ** 2).sum() - errors[-1]) < 1e-6 and (x >= 0).all()


THEMES = ["rain storm wind cloud thunder hail", "bread cheese butter flour yeast oven", "engine wheel brake gear clutch piston"]


def themed(spark):
    r = np.random.default_rng(3)
    rows = [(k, " ".join(r.choice(THEMES[k % 3].split(), 8)).upper() + " the and " + str(r.integers(9))) for k in range(90)]
    return spark.createDataFrame([*rows, (90, None), (91, ""), (92, "the 12 and"), (92, "rain, storm. WIND")], "doc_id long, text string").repartition(4)


def test_planted_topics_are_found(spark):
    found = factors.Topics(themed(spark), "text", 3)
    words = {}
    for x in found.words(6).orderBy("topic", "place").collect():
        words.setdefault(x["topic"], []).append(x["word"])
    assert sorted(map(sorted, words.values())) == sorted(sorted(t.split()) for t in THEMES) and set(words) == {1, 2, 3}
    topic = {r["doc_id"]: r["topic"] for r in found.assigned().where("doc_id < 92").collect()}
    assert [topic[k] for k in range(90)] == [topic[k % 3] for k in range(90)] and len({topic[k] for k in range(3)}) == 3
    assert topic[90] is None and topic[91] is None
    again = factors.Topics(themed(spark).coalesce(1), "text", 3)
    rounded = lambda t: sorted((r["topic"], r["place"], r["word"], round(r["weight"], 6)) for r in t.words(6).collect())
    assert rounded(found) == rounded(again)  # whatever the partitions


def test_vectors_of_texts(spark):
    found = factors.LatentSemantics(themed(spark), "text", 8)
    vectors = {r["doc_id"]: np.array(r["vector"]) for r in found.fitted().where("doc_id < 92").collect()}
    assert all(abs(np.linalg.norm(vectors[k]) - 1) < 1e-9 for k in range(90)) and not vectors[90].any()
    near = np.array([[vectors[a] @ vectors[b] for b in range(30)] for a in range(30)])
    same = np.arange(30)[:, None] % 3 == np.arange(30) % 3
    assert near[same].mean() > 0.5 > 0.3 > np.abs(near[~same]).max()
    asked = spark.createDataFrame([("storm and thunder",), ("unheard of",), (None,)], "q string")
    got = {r["q"]: np.array(r["vector"]) for r in found.encode(asked, "q").collect()}
    scores = [got["storm and thunder"] @ vectors[k] for k in range(90)]
    assert {k % 3 for k in np.argsort(scores)[-20:]} == {0} and not got["unheard of"].any() and not got[None].any()


def test_pairwise_cosines(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = r.standard_normal((23, 6))
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(50, None), (51, [0.0] * 6), (52, [float("nan")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    monkeypatch.setattr(learning, "ITEMS_A_BLOCK", 5)
    got = {(x["a"], x["b"]): x["similarity"] for x in learning.pairwise_cosines(df, "k", "v").collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert set(got) == {(a, b) for a in range(23) for b in range(a, 23)} and all(abs(s - u[a] @ u[b]) < 1e-6 for (a, b), s in got.items())
    monkeypatch.setattr(learning, "MOST_ITEMS", 22)
    with pytest.raises(ValueError):
        learning.pairwise_cosines(df, "k", "v")


def test_singular_values_by_a_few_components_at_a_time(spark, monkeypatch):
    r = np.random.default_rng(5)
    u, v = np.linalg.qr(r.standard_normal((50, 30)))[0], np.linalg.qr(r.standard_normal((40, 30)))[0]
    a = (u * np.logspace(1, -2, 30)) @ v.T
    df, _, cols = entries(spark, a)
    monkeypatch.setattr(factors, "HELD", 16 * 50 * 6)
    s, rows, columns = factors.svd(factors.Sparse(df, folder(spark), 300), cols, 5, folder(spark), rounds=4)
    want_u, want, want_v = np.linalg.svd(a)
    assert np.allclose(s, want[:5], rtol=1e-6)
    got = dense(rows, [k * 1000 for k in range(50)]) @ dense(columns, [k * 7 - 50 for k in range(40)]).T
    assert np.allclose(got, (want_u[:, :5] * want[:5]) @ want_v[:5], atol=1e-5)


def stored(work):
    return sum(f.stat().st_size for f in Path(work.removeprefix("file:")).rglob("*.parquet"))


def varied(spark):
    r = np.random.default_rng(6)
    name = lambda x: "word" + "".join(chr(97 + int(d)) for d in str(x))
    texts = [" ".join(name(int(x)) for x in r.random(300) ** 2 * 900) for _ in range(600)]
    return sum(map(len, texts)), spark.createDataFrame(enumerate(texts), "doc_id long, text string").repartition(4)


def test_vectors_leave_little_on_disk(spark):
    """Some 40,000 pairs of words have no table of vectors, and an entry takes a few bytes."""
    letters, df = varied(spark)
    found = factors.LatentSemantics(df, "text", 20)
    assert found.fitted().where("vector[0] != 0").count() == 600
    assert stored(found.weights.work) < 3 * letters


def left_by(spark, tmp_path, monkeypatch, name):
    """(rows of a registered query over varied texts, bytes of its intermediate tables, letters of the texts)"""
    letters, df = varied(spark)
    df.write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(factors, "folder", lambda _: f"file://{tmp_path}/work")
    return QUERIES[name](spark, f"{tmp_path}/in").collect(), stored(f"file:{tmp_path}/work"), letters


def test_topics_leave_little_on_disk(spark, tmp_path, monkeypatch):
    rows, left, letters = left_by(spark, tmp_path, monkeypatch, "topics")
    assert sum(r["texts"] for r in rows) == 600 and left < 0.8 * letters


def test_topic_words_leave_little_on_disk(spark, tmp_path, monkeypatch):
    rows, left, letters = left_by(spark, tmp_path, monkeypatch, "topic_words")
    assert sorted((r["topic"], r["place"]) for r in rows) == [(t, p) for t in range(1, 6) for p in range(1, 11)] and left < 0.8 * letters


def test_topic_examples_leave_little_on_disk(spark, tmp_path, monkeypatch):
    rows, left, letters = left_by(spark, tmp_path, monkeypatch, "topic_examples")
    assert sorted((r["topic"], r["place"]) for r in rows) == [(t, p) for t in range(1, 6) for p in range(1, 4)] and left < 0.8 * letters
