"""Tokens, lemmas, sketches, lookups and SQL functions by literal cases."""

import uuid

import pytest
from pyspark.sql import functions as F

from sieveline.functions import words
from sieveline.operators import govern, quality, search, sketches
from sieveline.sources import tables


def pairs(spark, text):
    found = spark.createDataFrame([(text,)], "s string").select(words.lemmas(F.col("s"))).first()[0]
    return None if found is None else [tuple(t) for t in found]


def test_tokens(spark):
    said = lambda t: [w for w, _ in pairs(spark, t)]
    assert said("He doesn't run; they're good-natured.") == ["he", "does", "n't", "run", ";", "they", "'re", "good", "-", "natured", "."]
    assert said("Won’t pay $1,000.50 (10/10) at 7:42, 3rd time... -- A+ “Größe”") == ["wo", "n’t", "pay", "$", "1,000.50", "(", "10/10", ")", "at", "7:42", ",", "3rd", "time", "...", "--", "a+", "“", "größe", "”"]
    assert said("O'clock O'Brien's isn't") == ["o'clock", "o'brien", "'s", "is", "n't"]
    assert said("") == [] and said(" \t\n") == [] and pairs(spark, None) is None


def test_lemmas(spark):
    cases = {
        "goods": "good", "better": "good", "greatest": "great", "fines": "fine", "was": "be", "n't": "not", "n’t": "not", "studies": "study", "classes": "class", "boxes": "box", "heroes": "hero", "stories": "story", "dies": "die",
        "running": "run", "planned": "plan", "calling": "call", "passed": "pass", "making": "make", "hoped": "hope", "rated": "rate", "noted": "note", "quoted": "quote", "agreed": "agree", "worked": "work", "behaved": "behave", "served": "serve",
        "reduced": "reduce", "charged": "charge", "used": "use", "children": "child", "this": "this", "bus": "bus", "is": "be", "thing": "thing", "bed": "bed", "morning": "morning", "it's": "it's", "10s": "10s", "größen": "größen", "+": "+",
    }
    df = spark.createDataFrame(list(cases.items()), "w string, l string")
    assert [tuple(r) for r in df.select("w", "l", words.lemma(F.col("w"))).collect() if r[1] != r[2]] == []


def test_signs_count_in_windows(spark):
    """The comma and the full stop are among the three tokens before a word."""
    said = ["not, in truth, good", "not in all good", "isn't he good", "no - good"]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    assert [r[0] for r in df.select(search.best_rules(F.col("s"))).collect()] == [True, False, False, False]
    assert spark.createDataFrame([("the finest, cooperatives",)], "s string").select(search.best_rules(F.col("s"))).first()[0]


def test_sketches_merge(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 50).cast("int").alias("few"), F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("text"), F.lit(None).cast("double").alias("none"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("day"))
    names = ["id", "few", "text", "none", "day"]
    parts = [sketches.sketch(df.where(F.col("id") % 3 == k), names) for k in range(3)]
    whole = sketches.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    got = {r["column_name"]: r for r in sketches.estimates(whole).collect()}
    for name, n, nulls in (("id", 20_000, 0), ("few", 50, 0), ("text", 15_000, 5_000), ("none", 0, 20_000), ("day", 7, 0)):
        assert got[name]["rows"] == 20_000 and got[name]["nulls"] == nulls and abs(got[name]["distinct_values"] - n) <= 0.03 * n
    assert abs(got["id"]["median"] - 10_000) < 300 and got["text"]["median"] is None and got["none"]["median"] is None
    same = {r["column_name"]: r for r in sketches.sketch_drift(whole, sketches.sketch(df, names)).collect()}
    assert same["id"]["shift"] <= 0.03 and same["text"]["shift"] is None and all(r["rows_change"] == r["nulls_change"] == 0 for r in same.values())
    half = {r["column_name"]: r for r in sketches.sketch_drift(whole, sketches.sketch(df.where("id >= 10000"), ["id", "few"])).collect()}
    assert abs(half["id"]["shift"] - 0.5) <= 0.03 and half["few"]["shift"] <= 0.03 and half["day"]["rows_change"] == -20_000


def test_lookup_reads_one_bucket(spark, tmp_path):
    df = spark.range(1, 2001).select("id", F.col("id").cast("string").alias("v"))
    name = f"lookup_{uuid.uuid4().hex}"
    rows = tables.save_lookup(df, name, "id", f"file://{tmp_path}/lookup", 8)
    try:
        found = tables.find_id(rows, "id", " 00000042 ")
        assert [tuple(r) for r in found.collect()] == [(42, "42")] and tables.find_id(rows, "id", "00009999").count() == 0
        assert len([f for f in (tmp_path / "lookup").iterdir() if f.suffix == ".parquet"]) == 8
        assert rows.where("id = 42").select(F.input_file_name()).count() == 1
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)
        assert "SelectedBucketsCount: 1 out of 8" in tables.find_id(spark.table(name), "id", "00000042")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.sql(f"DROP TABLE {name}")


def test_sql_functions(spark):
    spark.createDataFrame([("me", 1), ("me", 1), ("you", 2)], "reader string, unit int").createOrReplaceTempView("access_now")
    spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "u int, v string").createOrReplaceTempView("people_now")
    govern.create_mask(spark, "mask_now", ["it's", "b\\c"], "it's hidden")
    govern.create_mask(spark, "mask_all", [])
    govern.create_unit_filter(spark, "units_now", "access_now")
    ask = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert ask("SELECT u, mask_now(v, array('a', 'it\\'s')), mask_now(v, array('a')), mask_now(v, NULL), mask_all(v, array('a')) FROM people_now WHERE u IN (SELECT unit FROM units_now('me'))") == [(1, "x", "it's hidden", "it's hidden", "RESTRICTED")]
    assert ask("SELECT u FROM people_now WHERE u IN (SELECT unit FROM units_now('nobody'))") == []
    spark.createDataFrame([("me", 2)], "reader string, unit int").createOrReplaceTempView("access_now")
    govern.create_unit_filter(spark, "units_now", "access_now")
    assert ask("SELECT u FROM people_now WHERE u IN (SELECT unit FROM units_now('me'))") == [(2,)]


def test_padded_headers_are_reported(spark):
    df = spark.createDataFrame([(" a", "b")], "`x\t` string, y string")
    assert {tuple(r) for r in quality.whitespace(df, ["x\t", "y"]).collect()} == {("x", True, 1, 0), ("y", False, 0, 0)}


@pytest.mark.parametrize("key", [1, None])
def test_repeated_keys_are_inserted_once(spark, tmp_path, key):
    rows = spark.createDataFrame([(key, "a"), (key, "b")], "k int, v string")
    tables.insert_absent(rows, f"file://{tmp_path}/log", ["k"])
    tables.insert_absent(rows, f"file://{tmp_path}/log", ["k"])
    assert tables.read_log(spark, f"file://{tmp_path}/log", "").count() == 1


def test_reference_in_the_catalog(spark, tmp_path):
    name = f"ref_{uuid.uuid4().hex}"
    ref = spark.createDataFrame([("a", "1"), ("b", "2")], "source_value string, code string")
    tables.save_reference(ref, "source_value", f"file://{tmp_path}/ref", name, "codes; it's \\ agreed")
    try:
        listed = tables.list_tables(spark).where(F.col("table_name") == name).collect()
        assert {r["comment"] for r in listed} == {"codes; it's \\ agreed"} and spark.table(name).count() == 2
    finally:
        spark.sql(f"DROP TABLE {name}")
