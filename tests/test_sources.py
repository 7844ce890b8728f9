"""Logs, lookups, phrase search and the small classifiers."""

import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import learning, search
from sieveline.plans.registry import ORACLE_SQL, QUERIES
from sieveline.sources import tables


def test_find_id(spark):
    df = spark.createDataFrame([(42,), (7,), (None,)], "id bigint")
    assert [r.id for r in tables.find_id(df, "id", " 00000042").collect()] == [42]
    for bad in ("42", "0000004x", "", "٠٠٠٠٠٠٤٢"):
        with pytest.raises(ValueError):
            tables.find_id(df, "id", bad)


def test_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k bigint, note string")
    assert tables.read_log(spark, path, "k bigint, note string").count() == 0
    tables.insert_absent(rows, path, ["k"])
    tables.insert_absent(rows, path, ["k"])
    tables.append_log(spark.createDataFrame([(3, "c", 1)], "k bigint, note string, extra int"), path)
    assert sorted(map(tuple, tables.read_log(spark, path, "").collect()), key=str) == [(1, "a", None), (2, None, None), (3, "c", 1)]


def test_replace_rows(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "reader string, unit int")
    got = tables.replace_rows(df, F.col("reader") == "a", spark.createDataFrame([("a", 9)], "reader string, unit int"))
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 9), ("b", 3), (None, 2)]


def test_save_table_refuses(spark):
    with pytest.raises(ValueError):
        tables.save_table(spark.createDataFrame([(0,)], "id bigint"), "never_written", tables.id_rules("id"))
    assert not spark.catalog.tableExists("never_written")


def test_phrases(spark):
    texts = ["Refused to work", "he never refused to work", "he never ever once today refused to work", "not at all refused to work", "Good Friday", "good friday, good man", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rule = search.lexicon(F.col("t"), ["good"], ["never"], 3, phrases=["refused to work"], negating_phrases=["at all"], exclude_phrases=["good friday"])
    assert [r[0] for r in df.orderBy("k").select(rule).collect()] == [True, False, True, False, False, True, False, None]


def test_lexicon_by_tokens(spark):
    cases = {"good times here": True, "never had good conduct time, polite man": True, "isn't good": False, "lost good time": False, "goodness": False, "he is no longer polite": False, "was far from being great": False, "not in many long weeks good": True, "no issues": True, "never no issues": False, "goods came": False, "10/10": True, "": False, None: None}
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(search.best_rules(F.col("t"), {"goods": "good"})).collect()] == list(cases.values())


def test_topk_orders_by_the_exact_value(spark):
    rows = [(1, [1.0, 1e-4]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])]
    df, q = spark.createDataFrame(rows, "id int, v array<double>"), spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    assert [r["id"] for r in search.semantic_topk(df, q, "id", "v", 3).collect()] == [2, 3, 1]
    assert [r["id"] for r in search.semantic_topk(df, q, "id", "v", 3, once="v").collect()] == [2, 1, 4]


def test_few_shot_learns_a_plane(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((600, 8))
    rows = [(k, x.tolist(), bool(x[0] + x[3] > 0.5)) for k, x in enumerate(v)]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, truth boolean")
    train = learning.sample(e, "vec_id", 300)
    got = learning.few_shot(e.join(train.select("vec_id"), "vec_id", "left_anti"), train, "embedding", "truth")
    n, right = got.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("truth"))).first()
    assert n == 300 and right / n > 0.93


def test_split_is_stable(spark):
    df = spark.range(10_000)
    first = {r.id for r in df.where(learning.in_share("id", 0.8)).collect()}
    assert 7_700 < len(first) < 8_300 and first == {r.id for r in df.repartition(7).where(learning.in_share("id", 0.8)).collect()}


def test_inference_changes_only_ids_with_leading_zeros(spark, tmp_path):
    """IDs of seven digits with and without leading zeros, one missing, the others of eight with a tab behind them."""
    keys = [96, 999_002, 1_000_069, 8_999_950, 88, 41, 12_345_678]
    rows = spark.createDataFrame([(k, 1, "O", 1.0, datetime.datetime(2020, 1, 2), "1-URGENT") for k in keys], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    got = [tuple(r) for r in QUERIES["inferred_vs_text"](spark, str(tmp_path)).select("ids", "changed_by_inference").collect()]
    duck = duckdb.connect()
    duck.execute(f"create view orders as from '{tmp_path}/orders.parquet/*.parquet'")
    assert got == duck.execute(ORACLE_SQL["inferred_vs_text"]).fetchall() == [(6, 3)]
