"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, by operator and stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import bpe, common, itq, knn, langid, lines, mixing, simhash, substrings, toxicity

#: Names that operators use inside or for results.
CLASHES = ["score", "predicted", "_text", "_text_in", "_whole", "_host", "host", "n_lines", "n_dropped", "_lines", "_kept", "_common", "_hashes", "_id", "id", "_times", "_copy", "_size", "size", "_key", "key", "_own", "own", "_dig", "dig", "_plan", "stop", "epochs", "c0", "c1", "n_tokens", "ids", "decoded", "cls", "bucket", "taken", "target", "h", "page", "part"]
LONG = "long text of words " * 8000


def odd(spark, extra=()):
    rows = [(1, None, "a"), (2, "", None), (3, "one two three four five six", "a"), (3, "one two three four five six", "a"), (4, "x" * 5000, "b"), (None, "with no id", "b"), (None, "with no id", "b"), (5, "1 2 3", None), (6, LONG, "a"), (7, "same\nlines", "c"), (8, "same\nlines", "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("x"), "n_chars": F.length("text").cast("long")})
    return d.withColumns({n: F.lit(f"<{n}>") for n in extra})


def stages(spark, tmp_path):
    path = f"file://{tmp_path}/labels.parquet"
    spark.createDataFrame([(k, 1, k % 2) for k in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(path)
    return f"file://{tmp_path}"


def test_stages_keep_clashing_columns(spark, tmp_path):
    sf, d = stages(spark, tmp_path), odd(spark, CLASHES)
    plain = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, d, sf)
        assert got.columns == d.columns, name
        rows, bare = got.collect(), stage(spark, plain, sf).collect()
        assert all(r[c] == f"<{c}>" for r in rows for c in CLASHES), name
        assert sorted(str(tuple(r[c] for c in plain.columns)) for r in rows) == sorted(str(tuple(r)) for r in bare), name
    last = corpus_pipeline.bpe(spark, d, sf)
    assert last.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == d.count()


def test_stages_on_an_empty_table(spark, tmp_path):
    sf, d = stages(spark, tmp_path), odd(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, sf).count() == 0, name


def test_stages_on_odd_rows(spark, tmp_path):
    sf, d = stages(spark, tmp_path), odd(spark)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, d, sf).collect()}
    assert got[1] is None and got[2] == "" and got[6] == LONG and got[7] == "same\nlines"
    kept = sorted(str((r["doc_id"], r["text"])) for r in corpus_pipeline.simhash_near_dedup(spark, d, sf).collect())
    # null and empty texts are one group, copies too, with and without an id
    assert kept == sorted(str(x) for x in [(1, None), (3, "one two three four five six"), (4, "x" * 5000), (None, "with no id"), (5, "1 2 3"), (6, LONG), (7, "same\nlines")])
    mixed = corpus_pipeline.mixing(spark, d, sf).collect()
    assert {r["doc_id"] for r in mixed} <= {3, 4, 5, 6, 7, 8, None} and all(r["text"] for r in mixed)


def test_digests_keep_clashing_columns(spark):
    d = odd(spark, ["ids", "decoded", "n_tokens", "cls"])
    got = bpe.digests(d, bpe.vocabulary("byte_bpe_50k.json")).collect()
    assert all((r["ids"], r["decoded"], r["cls"]) == ("<ids>", "<decoded>", "<cls>") for r in got)
    assert {r["doc_id"]: r["n_tokens"] for r in got}[1] == 0  # the result's own name is replaced


def test_operators_look_at_their_columns_only(spark):
    plain, extra = odd(spark), odd(spark, CLASHES)
    model = toxicity.train(["a b", "c d"], np.array([0, 1]))
    for run in (
        lambda d: substrings.repeated_spans(d, min_bytes=10), simhash.simhash_components, mixing.mix, lambda d: toxicity.score(d, model),
        lambda d: langid.identify(d, {"x": np.array([97])}), lambda d: lines.drop_boilerplate(d, F.col("source"), F.col("text")).select("doc_id", "text", "host", "n_lines", "n_dropped"),
    ):
        assert sorted(map(str, run(plain).collect())) == sorted(map(str, run(extra).collect()))


VECTORS = [(0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (7, [-1.0, -2.0]), (8, []), (9, [1.0, 2.1]), (9, [1.0, 2.1]), (9, [-5.0, 1.0]), (50, [1e-300, 2e-300]), (100, None)]


def vectors(spark, rows, **extra):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    return d.withColumns({k: F.lit(v) for k, v in extra.items()})


def test_vectors_odd(spark):
    got = sorted((-1 if r["id"] is None else r["id"], r["n_links"], r["component_id"]) for r in itq.linked_vectors(vectors(spark, VECTORS, key="x", cls="x", n=1)).collect())
    by = {}
    for i, n, c in got:
        by.setdefault(i, []).append((n, c))
    # [1, 2] by 0, 1, 50 (another length, same direction) and twice 9; opposite and odd ones alone
    assert by[0] == by[1] == by[50] == [(4, 0)] and by[9] == [(0, 9), (4, 0), (4, 0)] or sorted(by[9]) == [(0, 0), (4, 0), (4, 0)]
    assert all(by[i] == [(0, i)] for i in (2, 3, 4, 5, 6, 7, 8, 100)) and by[-1] == [(0, None)]


def test_nearest_odd(spark):
    got = {}
    for r in knn.nearest(vectors(spark, VECTORS, node="x", key="x"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    # all other candidates, opposite ones too, where there are fewer than five
    assert sorted(got[0]) == [1, 7, 9, 50] and sorted(got[50]) == [0, 1, 7, 9] and set(got) == {0, 50}
    assert got[0][:2] == [1, 50] and got[50][:2] == [0, 1] and got[0][-1] == 7
    alone = knn.nearest(vectors(spark, [(0, [1.0]), (3, None)]), F.col("vec_id") % 50 == 0)
    assert alone.count() == 0


def test_nearest_ties_and_copies(spark):
    rows = [(k, [1.0, 0.0] if k < 8 else [0.0, 1.0]) for k in range(12)]
    got = knn.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_shared_folder_is_asked_for(spark, monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        common.shared_root(Cluster)


def test_scratch_is_cleared_by_age(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_root", lambda _: f"file://{tmp_path}")
    scratch = common.Scratch(spark, "some-test")
    scratch.write(spark.range(3), "t")
    (tmp_path / "else").mkdir()
    assert common.clear_scratch(spark, 1) == [] and common.clear_scratch(spark, -1) == [scratch.base.rsplit("/", 1)[1]]
    assert [p.name for p in tmp_path.iterdir()] == ["else"]
