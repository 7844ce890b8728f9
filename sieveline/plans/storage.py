"""Registered queries over scans, sinks, logs, listings and histories."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import convert, dates, text
from ..operators import quality, sketches
from ..sources import tables
from .base import _DATE, _FLAG, _ID, _K, _MONEY, _P, _POINTS, _TIME, _clean, folder, query
from .messy import messy_orders, table

_IDS = f"CASE WHEN {_K} % 97 = 0 THEN lpad(CAST({_K} AS VARCHAR), 7, '0') WHEN {_K} % 89 = 0 THEN NULL ELSE lpad(CAST({_K} AS VARCHAR), 8, '0') END"


def _delivered(spark, sf_dir):
    """Messy orders as a delivered CSV: (path, its columns)."""
    path = folder(spark)
    rows = messy_orders(spark, sf_dir).select("k", F.trim("id_text").alias("id_text"), "o_orderstatus")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path, rows.columns


@query(f"SELECT {_K} AS k, {_IDS} AS id_text FROM orders")
def id_columns_scan(spark, sf_dir):
    return text.strip_and_null(tables.read_text(spark, *_delivered(spark, sf_dir)).select("k", "id_text")).withColumn("k", F.col("k").cast("long"))


@query(f"SELECT count({_IDS}) AS ids, CAST(sum(CASE WHEN CAST(CAST({_IDS} AS BIGINT) AS VARCHAR) <> {_IDS} THEN 1 ELSE 0 END) AS BIGINT) AS changed_by_inference FROM orders")
def inferred_vs_text(spark, sf_dir):
    path, columns = _delivered(spark, sf_dir)
    plain = text.strip_and_null(tables.read_text(spark, path, columns)).select(F.col("k").cast("long").alias("k"), "id_text")
    guessed = tables.read_inferred(spark, path).select(F.col("k").cast("long").alias("k"), F.trim(F.col("id_text").cast("string")).alias("guess"))
    return plain.join(guessed, "k").agg(F.count("id_text").alias("ids"), F.count_if(F.col("id_text") != F.col("guess")).alias("changed_by_inference"))


@query(f"SELECT {_ID} AS id, o_orderstatus AS answer FROM orders WHERE {_ID} IS NOT NULL")
def answer_key_join(spark, sf_dir):
    key = tables.read_key(spark, *_delivered(spark, sf_dir), "id_text").select(F.col("id_text").alias("id"), F.col("o_orderstatus").alias("answer"))
    return _clean(spark, sf_dir).select("id").join(key, "id")


@query(f"SELECT {_ID} AS id, {_IDS} AS before_text, {_DATE} AS after_date FROM orders WHERE {_ID} IS NOT NULL")
def cast_key_join(spark, sf_dir):
    bronze = text.strip_and_null(messy_orders(spark, sf_dir)).select(F.col("id_text").alias("before_text"))
    typed = _clean(spark, sf_dir).select("id", F.col("order_date").alias("after_date"))
    return typed.join(bronze, F.col("id") == F.col("before_text").try_cast("bigint"))


@query(f"SELECT {_ID} AS id, lpad(CAST({_ID} AS VARCHAR), 8, '0') AS written FROM orders WHERE {_ID} IS NOT NULL")
def handoff_padded(spark, sf_dir):
    path = folder(spark)
    tables.hand_off(_clean(spark, sf_dir).where("id IS NOT NULL").select("id", F.col("id").alias("written")), path, ["written"])
    return tables.read_text(spark, path, ["id", "written"]).withColumn("id", F.col("id").cast("long"))


_NULLS = f"CAST(sum(CASE WHEN {_ID} IS NULL THEN 1 ELSE 0 END + CASE WHEN {_DATE} IS NULL THEN 1 ELSE 0 END + CASE WHEN {_MONEY} IS NULL THEN 1 ELSE 0 END) AS BIGINT)"


@query(" UNION ALL ".join(f"SELECT '{s}' AS stage, {_NULLS} AS nulls FROM orders" for s in ("given", "parquet", "csv")))
def round_trip_nulls(spark, sf_dir):
    return tables.round_trip_nulls(_clean(spark, sf_dir).select("id", "order_date", "money"), folder(spark))


@query(f"SELECT {_ID} AS id, {_MONEY} AS money FROM orders WHERE {_ID} IS NOT NULL")
def table_round_trip(spark, sf_dir):
    name, path = f"typed_{uuid.uuid4().hex}", folder(spark)
    tables.save_table(_clean(spark, sf_dir).where("id IS NOT NULL").select("id", "money"), name, tables.id_rules("id"), "typed orders", path, ["id"])
    listed = tables.list_tables(spark).where(F.col("table_name") == name).select("comment").distinct().first()
    spark.sql(f"DROP TABLE {name}")
    if listed is None or listed.comment != "typed orders":
        raise ValueError("the table lacks its comment")
    return spark.read.parquet(path)


@query("""SELECT column_name, type_before, type_after, type_before <> type_after AS changed, n AS typed_values FROM (
 SELECT 'id' AS column_name, 'string' AS type_before, 'bigint' AS type_after, count(""" + _ID + """) AS n FROM orders
 UNION ALL SELECT 'money', 'string', 'decimal(12,2)', count(""" + _MONEY + """) FROM orders UNION ALL SELECT 'time', 'string', 'string', count(""" + _TIME + """) FROM orders)""")
def type_comparison(spark, sf_dir):
    rows, path = _clean(spark, sf_dir), folder(spark)
    before = rows.select(F.col("id_text").alias("id"), F.col("money_text").alias("money"), F.col("time_text").alias("time"))
    rows.select("id", "money", "time").write.parquet(path)
    stored = spark.read.parquet(path)
    n = quality.long_form(stored.agg(*[F.count(c).alias(c) for c in stored.columns]), "column_name", "typed_values")
    return tables.compare_types(before, stored).join(n, "column_name")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def sql_view(spark, sf_dir):
    name = f"lines_{uuid.uuid4().hex}"
    table(spark, sf_dir, "lineitem").createOrReplaceTempView(name)
    return spark.sql(f"SELECT l_returnflag, count(*) AS n FROM {name} GROUP BY l_returnflag")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20")
def preview_range(spark, sf_dir):
    return tables.row_range(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 20, 30)


@query(f"SELECT {_K} AS k, o_custkey FROM orders WHERE {_ID} = 42")
def id_lookup(spark, sf_dir):
    return tables.find_id(_clean(spark, sf_dir), "id", " 00000042 ").select("k", "o_custkey")


@query(f"SELECT {_K} AS k, o_custkey FROM orders WHERE {_ID} = 42")
def bucketed_lookup(spark, sf_dir):
    """The same from a table bucketed by the ID, of which one bucket is read."""
    name, path = f"lookup_{uuid.uuid4().hex}", folder(spark)
    rows = tables.save_lookup(_clean(spark, sf_dir).where("id IS NOT NULL").select("id", "k", "o_custkey"), name, "id", path, 16)
    out = folder(spark)
    tables.find_id(rows, "id", "00000042").select("k", "o_custkey").write.parquet(out)
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(out)


_YEARS = "year(l_shipdate) < 1999"
_SKETCHED = ("l_quantity", "l_extendedprice", "l_partkey", "l_returnflag")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE NOT {_YEARS}) - count(*) FILTER (WHERE {_YEARS}) AS rows_change, count(*) FILTER (WHERE NOT {_YEARS} AND {c} IS NULL) - count(*) FILTER (WHERE {_YEARS} AND {c} IS NULL) AS nulls_change, TRUE AS distinct_close, {'NULL' if c == 'l_returnflag' else 'TRUE'} AS median_close FROM lineitem" for c in _SKETCHED))
def sketch_drift(spark, sf_dir):
    """Snapshots by year, sketched once each and merged to two periods; estimates are held against exact values."""
    rows, out = table(spark, sf_dir, "lineitem").select("l_shipdate", *_SKETCHED), folder(spark)
    years = [r["y"] for r in rows.select(F.year("l_shipdate").alias("y")).distinct().collect()]
    for y in years:
        sketches.sketch(rows.where(F.year("l_shipdate") == y), _SKETCHED).withColumn("year", F.lit(y)).write.mode("append").parquet(out)
    stored = spark.read.parquet(out)
    before, after = (sketches.merge(stored.where(w)) for w in ("year < 1999", "year >= 1999"))
    drift = sketches.sketch_drift(before, after)
    late = rows.where(f"NOT ({_YEARS})")
    exact = [late.agg(F.lit(c).alias("column_name"), F.count_distinct(c).alias("d"), *([F.percentile(c, F.array(F.lit(0.47), F.lit(0.53))).alias("m")] if c != "l_returnflag" else [F.lit(None).cast("array<double>").alias("m")])) for c in _SKETCHED]
    truth = exact[0]
    for x in exact[1:]:
        truth = truth.unionByName(x)
    both = drift.join(sketches.estimates(after), "column_name").join(truth, "column_name")
    close = F.abs(F.col("distinct_values") - F.col("d")) <= 0.03 * F.col("d")
    return both.select("column_name", "rows_change", "nulls_change", close.alias("distinct_close"), F.col("median").between(F.col("m")[0], F.col("m")[1]).alias("median_close"))


@query(f"SELECT {_K} AS k, 'first' AS note FROM orders WHERE {_K} % 5 = 0 UNION ALL SELECT {_K}, 'second' FROM orders WHERE {_K} % 10 < 5 AND {_K} % 5 <> 0")
def review_log(spark, sf_dir):
    path, keys = folder(spark), messy_orders(spark, sf_dir).select("k")
    for rows in (keys.where("k % 5 = 0").withColumn("note", F.lit("first")), keys.where("k % 10 < 5").withColumn("note", F.lit("second"))):
        tables.insert_absent(rows, path, ["k"])
        tables.insert_absent(rows, path, ["k"])
    return tables.read_log(spark, path, "k bigint, note string")


@query("SELECT n_nationkey AS unit, CASE WHEN n_regionkey = 1 THEN 'reviewer' ELSE 'reader ' || CAST(n_regionkey AS VARCHAR) END AS reader FROM nation")
def mapping_update(spark, sf_dir):
    unit = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit"), F.concat(F.lit("reader "), F.col("n_regionkey").cast("string")).alias("reader"))
    new = unit.where("reader = 'reader 1'").withColumn("reader", F.lit("reviewer"))
    return tables.replace_rows(unit, F.col("reader") == "reader 1", new)


_SUSPECT = (("date_text", "02/30/2020", 61), ("money_text", "TBD", 53), ("time_text", "25:10", 43), ("flag_text", "?", 41), ("priority_text", "XX", 83))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS token, count(*) AS n FROM orders WHERE {_K} % {m} = 0 HAVING count(*) > 0" for c, t, m in _SUSPECT))
def suspect_tokens(spark, sf_dir):
    return quality.suspects(text.strip_and_null(messy_orders(spark, sf_dir)), [c for c, _, _ in _SUSPECT], [t for _, t, _ in _SUSPECT])


@query(f"SELECT {_K} AS k, {_K} % 59 = 0 AND {_K} % 53 <> 0 AS no_money FROM orders")
def table_null_tokens(spark, sf_dir):
    return text.table_null_tokens(messy_orders(spark, sf_dir)).select("k", F.col("money_text").isNull().alias("no_money"))


@query(f"SELECT {_K} AS k, CAST(CASE WHEN {_K} % 53 = 0 OR {_K} % 59 = 0 OR {_K} % 6 = 5 THEN NULL ELSE {_P} END AS DECIMAL(12,2)) AS price FROM orders")
def price_parse(spark, sf_dir):
    return messy_orders(spark, sf_dir).select("k", convert.to_price(F.col("money_text")).alias("price"))


@query(f"SELECT {_K} AS k, CASE WHEN {_K} % 9 = 0 AND {_K} % 61 <> 0 AND {_K} % 67 <> 0 THEN CAST(o_orderdate AS DATE) END AS order_date FROM orders")
def single_format_dates(spark, sf_dir):
    raw = text.strip_and_null(messy_orders(spark, sf_dir))
    whole = F.when(F.col("date_text").rlike(dates.FORMATS[0][1]), F.col("date_text"))
    return raw.select("k", F.try_to_timestamp(whole, F.lit("MM/dd/yyyy")).cast("date").alias("order_date"))


@query(f"SELECT {_K} AS k, CASE WHEN {_K} % 9 IN (3, 4) THEN {_DATE} END AS guessed, {_DATE} AS explicit FROM orders")
def guess_vs_explicit(spark, sf_dir):
    return _clean(spark, sf_dir).select("k", F.col("date_text").try_cast("date").alias("guessed"), F.col("order_date").alias("explicit"))


@query("""WITH e AS (SELECT event_type AS dataset, unnest(['value present', 'value at least 50']) AS rule, unnest([value IS NOT NULL, value >= 50]) AS ok FROM events)
 SELECT dataset, rule, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT coalesce(ok, FALSE)) AS failed FROM e GROUP BY dataset, rule""")
def json_metrics(spark, sf_dir):
    rules = {"value present": F.col("value").isNotNull(), "value at least 50": F.coalesce(F.col("value") >= 50, F.lit(False))}
    cells = [F.struct(F.col("event_type").alias("dataset"), F.lit(n).alias("name"), ok.cast("long").alias("passed"), (~ok).cast("long").alias("failed")) for n, ok in rules.items()]
    log = table(spark, sf_dir, "events").select(F.to_json(F.array(*cells)).alias("details"))
    return quality.expectation_metrics(log, "details")


@query("""SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type AS run, count(*) FILTER (WHERE value >= 50) AS passed, count(*) FILTER (WHERE NOT coalesce(value >= 50, FALSE)) AS failed FROM events GROUP BY 1, 2""")
def quality_history(spark, sf_dir):
    ok = F.coalesce(F.col("value") >= 50, F.lit(False))
    by = table(spark, sf_dir, "events").groupBy(F.date_trunc("HOUR", "ts").alias("t"), F.col("event_type").alias("run")).agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))
    return by.select(F.date_format("t", "yyyy-MM-dd HH").alias("hour"), "run", "passed", "failed")


@query("""WITH p AS (SELECT c_nationkey < 12 AS old, 'c_mktsegment' AS column_name, c_mktsegment AS v FROM customer UNION ALL SELECT c_nationkey < 12, 'c_name', c_name FROM customer)
 SELECT column_name, count(*) FILTER (WHERE NOT old) - count(*) FILTER (WHERE old) AS rows_change, count(DISTINCT v) FILTER (WHERE NOT old) - count(DISTINCT v) FILTER (WHERE old) AS distinct_change,
 (count(*) FILTER (WHERE NOT old AND v IS NULL) - count(*) FILTER (WHERE old AND v IS NULL)) AS nulls_change FROM p GROUP BY column_name""")
def profile_drift(spark, sf_dir):
    c, names = table(spark, sf_dir, "customer"), ["c_mktsegment", "c_name"]
    return quality.drift(*[quality.profile(c.where(w), names, exact=True) for w in ("c_nationkey < 12", "c_nationkey >= 12")])


@query("""SELECT user_id AS run, count(*) AS steps, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended,
 CAST(floor(epoch_us(max(ts)) / 1000000.0 - epoch_us(min(ts)) / 1000000.0) AS BIGINT) AS seconds, last(event_type ORDER BY ts, event_id) AS state FROM events GROUP BY user_id""")
def run_rollup(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("steps"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    micros = lambda c: F.expr(f"unix_micros(CAST({c} AS TIMESTAMP))")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return by.select("run", "steps", shown("a").alias("began"), shown("b").alias("ended"), F.floor((micros("b") - micros("a")) / 1000000).alias("seconds"), "state")


_NAIVE_DATE = f"{_K} % 61 <> 0 AND {_K} % 67 <> 0 AND {_K} % 9 IN (3, 4)"
_BARE = f"{_K} % 53 <> 0 AND {_K} % 59 <> 0 AND {_K} % 6 = 1"
_SPELLED = f"CASE WHEN {_K} % 83 = 0 THEN 'XX' ELSE CAST(CASE WHEN {_K} % 4 = 3 THEN 3 ELSE {_K} % 4 END AS VARCHAR) || o_orderpriority END"
_KEYED = f"CASE WHEN {_K} % 83 = 0 THEN 'XX' ELSE o_orderpriority END"
_TRUST = (
    ("usable dates", f"count(*) FILTER (WHERE {_NAIVE_DATE})", f"count({_DATE})"),
    ("flagged rows", f"count(*) FILTER (WHERE {_K} % 41 <> 0 AND {_K} % 15 = 0)", f"count(*) FILTER (WHERE {_FLAG})"),
    ("total money in cents", f"coalesce(CAST(sum(CASE WHEN {_BARE} THEN {_P} * 100 END) AS BIGINT), 0)", f"CAST(sum({_MONEY} * 100) AS BIGINT)"),
    ("total points", f"coalesce(CAST(sum(CASE WHEN {_K} % 47 <> 0 AND {_K} % 5 IN (0, 1) THEN {_K} % 11 END) AS BIGINT), 0)", f"CAST(sum({_POINTS}) AS BIGINT)"),
    ("spellings of a priority", f"count(DISTINCT {_SPELLED})", f"count(DISTINCT {_KEYED})"),
    ("records with an id", f"count(*) FILTER (WHERE {_K} % 89 <> 0 OR {_K} % 97 = 0)", f"count({_ID})"),
    ("usable times", f"count(*) FILTER (WHERE {_K} % 43 <> 0 AND {_K} % 7 = 0)", f"count({_TIME})"),
    ("latest year", f"CAST(max(CASE WHEN {_NAIVE_DATE} THEN year(o_orderdate) END) AS BIGINT)", f"CAST(max(year({_DATE})) AS BIGINT)"),
)


@query(" UNION ALL ".join(f"SELECT '{q}' AS question, {a} AS naive, {b} AS typed, ({a}) IS DISTINCT FROM ({b}) AS changed FROM orders" for q, a, b in _TRUST))
def trust_questions(spark, sf_dir):
    rows, c = _clean(spark, sf_dir), F.col
    guess = c("date_text").try_cast("date")
    naive = [F.count(guess), F.count_if(c("flag_text") == "Y"), F.sum(c("money_text").try_cast("decimal(12,2)") * 100), F.sum(F.when(c("points_text").rlike(r"^\d+$"), c("points_text").try_cast("bigint"))),
             F.count_distinct("priority_text"), F.count("id_text"), F.count_if(c("time_text").rlike(r"^([01]\d|2[0-3]):[0-5]\d$")), F.max(F.year(guess))]
    typed = [F.count("order_date"), F.count_if("flag"), F.sum(c("money") * 100), F.sum("points"), F.count_distinct(text.domain_key(c("priority_text"))), F.count("id"), F.count("time"), F.max(F.year("order_date"))]
    return quality.scorecard(rows, [q for q, _, _ in _TRUST], naive, typed)


@query("""SELECT c_mktsegment AS spelling, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment, c_custkey FROM customer) WHERE c_custkey % 3 = 0 GROUP BY 1""")
def leftover_spellings(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("spelling"))
    known = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("spelling")).distinct()
    return c.groupBy("spelling").agg(F.count("*").alias("n")).join(known, "spelling", "left_anti")


@query("SELECT o_custkey, count(*) AS records, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS place FROM orders GROUP BY o_custkey ORDER BY records DESC, o_custkey LIMIT 20")
def records_per_person(spark, sf_dir):
    top = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "o_custkey").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("records"), "o_custkey")).cast("long"))


@query(f"""SELECT 'id_text' AS column_name, FALSE AS header_padded, count(*) FILTER (WHERE {_K} % 97 <> 0) AS padded, count(*) FILTER (WHERE {_K} % 97 <> 0 AND {_K} % 89 = 0) AS blank FROM orders
 UNION ALL SELECT 'date_text', TRUE, count(*) FILTER (WHERE {_K} % 61 <> 0 AND {_K} % 67 = 0), count(*) FILTER (WHERE {_K} % 61 <> 0 AND {_K} % 67 = 0) FROM orders""")
def whitespace_report(spark, sf_dir):
    return quality.whitespace(messy_orders(spark, sf_dir).withColumnRenamed("date_text", "date_text "), ["id_text", "date_text "])


@query("SELECT p_partkey, list_contains(string_split(p_type, ' '), 'STEEL') AS listed, contains(p_type, 'STEEL') AS contained FROM part")
def contains_vs_exact(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_contains(F.split("p_type", " "), "STEEL").alias("listed"), F.contains("p_type", F.lit("STEEL")).alias("contained"))


@query(f"SELECT {_K} AS k, CAST({_K} % 83 = 0 AS INT) + CAST({_K} % 79 = 0 AS INT) AS unmapped FROM orders WHERE {_K} % 83 = 0 OR {_K} % 79 = 0")
def unmapped_per_row(spark, sf_dir):
    rows = text.strip_and_null(messy_orders(spark, sf_dir))
    n = (F.col("priority_text") == "XX").cast("int") + F.col("group_text").contains("/").cast("int")
    return rows.select("k", n.alias("unmapped")).where("unmapped > 0")
