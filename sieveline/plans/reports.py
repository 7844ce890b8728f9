"""Registered queries over crosswalks, reports, conversions and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convert, text
from ..operators import quality
from ..sources import tables
from .base import _DATE, _FLAG, _ID, _K, _MONEY, _POINTS, _PRIORITY, _TIME, TEXTS, _clean, folder, query
from .messy import CODED, messy_codes, messy_orders, table

_CLEAN = {"priority": "o_orderpriority", "segment": "c_mktsegment", "nation": "n_name", "region": "r_name", "status": "o_orderstatus", "group": "CASE WHEN o_orderkey % 2 = 0 THEN 'ALPHA' ELSE 'BETA-ONE' END"}
_JOINED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def references(spark, sf_dir) -> dict:
    """The six crosswalks as reference tables (source_value, value), saved with checked keys and loaded as text."""
    clean = {"priority": ("orders", "o_orderpriority"), "segment": ("customer", "c_mktsegment"), "nation": ("nation", "n_name"), "region": ("region", "r_name"), "status": ("orders", "o_orderstatus")}
    found = {n: table(spark, sf_dir, t).select(F.col(c).alias("value")).distinct() for n, (t, c) in clean.items()}
    found["group"] = spark.createDataFrame([("ALPHA",), ("BETA-ONE",)], "value string")
    out = folder(spark)
    for name, values in found.items():
        tables.save_reference(values.select(text.domain_key(F.col("value")).alias("source_value"), "value"), "source_value", f"{out}/{name}")
    return {n: tables.load_reference(spark, f"{out}/{n}") for n in found}


def _coded(spark, sf_dir):
    refs = references(spark, sf_dir)
    rows = text.strip_and_null(messy_codes(spark, sf_dir))
    return quality.apply_domains(rows, [(text.domain_key(F.col(f"{c}_text")), refs[c], "source_value", {"value": c}) for c in CODED])


@query(f"SELECT {_K} AS k, " + ", ".join(f'CASE WHEN {_K} % {m} = 0 THEN NULL ELSE {_CLEAN[c]} END AS "{c}"' for c, m in CODED.items()) + f" FROM {_JOINED}")
def six_crosswalks(spark, sf_dir):
    return _coded(spark, sf_dir).select("k", *CODED)


@query(" UNION ALL ".join(f"""SELECT {_K} AS k, '{c}_text' AS "column", 'XX' AS value_as_written, 'not in the crosswalk' AS reason FROM {_JOINED} WHERE {_K} % {m} = 0""" for c, m in CODED.items()))
def six_domain_exceptions(spark, sf_dir):
    parts = [(f"{c}_text", F.col(f"{c}_text"), convert.failed(F.col(f"{c}_text"), F.col(c)), "not in the crosswalk") for c in CODED]
    return quality.exceptions(_coded(spark, sf_dir), "k", parts)


@query(f"""SELECT * FROM ({" UNION ALL ".join(f"SELECT {_K} AS k, '{c}_text' AS column_name FROM {_JOINED} WHERE {_K} % {m} = 0" for c, m in CODED.items())}) ORDER BY k, column_name LIMIT 25""")
def ordered_exceptions(spark, sf_dir):
    """The first exceptions by ID and column: an order that does not depend on the partitions."""
    return six_domain_exceptions(spark, sf_dir).select("k", F.col("column").alias("column_name")).orderBy("k", "column_name").limit(25)


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment FROM customer")
def code_membership(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    listed = c.select(F.col("c_mktsegment").alias("code")).distinct()
    said = F.when(F.col("c_custkey") % 5 == 0, "ELSEWHERE").otherwise(F.col("c_mktsegment"))
    return quality.member(c, said, listed, "code", "segment").select("c_custkey", "segment")


@query(f"""SELECT {_K} AS k, o_custkey, o_orderpriority FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1)""")
def conflict_rows(spark, sf_dir):
    """All rows of the people whose codes conflict."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("k"), "o_custkey", "o_orderpriority")
    return quality.rows_of(o, quality.conflicts(o, "o_custkey", "o_orderpriority", ["5-LOW"]), "o_custkey").select("k", "o_custkey", "o_orderpriority")


_STATES = {"date_text": (f"({_K} % 67 = 0 AND {_K} % 61 <> 0)", f"({_K} % 61 = 0)"), "money_text": ("FALSE", f"({_K} % 53 = 0)"), "points_text": ("FALSE", f"({_K} % 47 = 0)"), "time_text": ("FALSE", f"({_K} % 43 = 0)"), "flag_text": ("FALSE", f"({_K} % 41 = 0)")}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {m}) AS missing, count(*) FILTER (WHERE {f}) AS failed, count(*) FILTER (WHERE NOT {m} AND NOT {f}) AS converted FROM orders" for c, (m, f) in _STATES.items()))
def conversion_report(spark, sf_dir):
    return quality.conversion_report(_clean(spark, sf_dir), {c: (F.col(f"as_written.{c}"), F.col(v)) for c, v in TEXTS.items()})


@query(f"""SELECT 'records' AS check_name, count(*) AS n FROM orders UNION ALL SELECT 'distinct ids', count(DISTINCT {_ID}) FROM orders UNION ALL SELECT 'missing', count(*) FILTER (WHERE {_ID} IS NULL) FROM orders
 UNION ALL SELECT 'out of range', 0 UNION ALL SELECT 'is bigint', 1""")
def id_check(spark, sf_dir):
    return quality.id_check(_clean(spark, sf_dir), "id")


@query(f"SELECT {_ID} AS id_text, {_K} AS k FROM orders WHERE {_ID} IS NOT NULL")
def strict_id_gate(spark, sf_dir):
    rows = text.strip_and_null(messy_orders(spark, sf_dir)).where(convert.id_problem(F.col("id_text")).isNull())
    return quality.strict_ids(rows.select("id_text", "k"), "id_text")


@query("SELECT 'o_orderpriority' AS check_name, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS n FROM orders UNION ALL SELECT 'o_orderstatus', 0")
def allowed_values(spark, sf_dir):
    lists = {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], "o_orderstatus": ["F", "O", "P"]}
    return quality.counts(table(spark, sf_dir, "orders"), {c: convert.outside(F.col(c), v) for c, v in lists.items()})


@query(f"SELECT {_K} AS k, o_custkey, {_ID} AS id FROM orders")
def column_order(spark, sf_dir):
    """The columns of the delivery first, in their order, then those added."""
    found = text.in_order(_clean(spark, sf_dir).select("id", "o_custkey", "k"), ["k", "o_custkey"])
    if found.columns != ["k", "o_custkey", "id"]:
        raise ValueError(f"columns out of order: {found.columns}")
    return found


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(30,2)) AS total FROM lineitem GROUP BY l_returnflag")
def line_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", convert.to_quantity(F.format_number(F.col("l_quantity"), 0)).alias("q"), convert.to_price(F.concat(F.lit("$"), F.format_number(F.col("l_extendedprice"), 2))).alias("p"))
    return rows.groupBy("l_returnflag").agg(F.sum(convert.line_total(F.col("q"), F.col("p"))).cast("decimal(30,2)").alias("total"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_orderkey * 1000 AS BIGINT) END AS quantity FROM lineitem")
def quantity_commas(spark, sf_dir):
    said = F.when(F.col("l_linenumber") == 3, F.lit("2.5")).otherwise(F.format_number(F.col("l_orderkey") * 1000, 0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", convert.to_quantity(said).alias("quantity"))


@query(f"SELECT {_K} AS k, CASE WHEN {_K} % 43 <> 0 AND {_K} % 7 IN (0) THEN {_TIME} END AS time FROM orders")
def single_format_times(spark, sf_dir):
    raw = F.col("time_text")
    whole = F.when(raw.rlike(r"^\d{2}:\d{2}$"), raw)
    return messy_orders(spark, sf_dir).select("k", F.date_format(convert.single_format(whole, "HH:mm"), "HH:mm:ss").alias("time"))


@query("SELECT p_partkey, lpad(CAST(p_partkey % 10 AS VARCHAR), 2, '0') || chr(CAST(65 + p_partkey % 26 AS INT)) AS code FROM part")
def offense_key_parts(spark, sf_dir):
    """Codes of two digits and a letter, with the zero lost, in small letters, with a hyphen, a space or a trailing .0."""
    digits, letter = (F.col("p_partkey") % 10).cast("string"), F.expr("char(65 + p_partkey % 26)")
    forms = [F.concat(digits, letter), F.concat(F.lit("0"), digits, F.lower(letter)), F.concat(F.lit("0"), digits, F.lit("-"), letter), F.concat(F.lit("0"), digits, F.lit(" "), letter, F.lit(".0"))]
    said = F.element_at(F.array(*forms), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.offense_key(said).alias("code"))


@query("SELECT n_nationkey, n_name FROM nation")
def padded_headers(spark, sf_dir):
    padded = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(" n_nationkey "), F.col("n_name").alias("n_name\t"))
    return text.strip_headers(padded)


@query(f"SELECT o_orderpriority AS name, count(DISTINCT CASE WHEN {_K} % 4 = 0 THEN lower(o_orderpriority) WHEN {_K} % 4 = 1 THEN replace(o_orderpriority, '-', ' - ') WHEN {_K} % 4 = 2 THEN o_orderpriority || '.' ELSE o_orderpriority END) AS spellings FROM orders WHERE {_K} % 83 <> 0 GROUP BY 1")
def spelling_counts(spark, sf_dir):
    rows = text.strip_and_null(messy_orders(spark, sf_dir)).where("k % 83 <> 0")
    return rows.groupBy(text.domain_key(F.col("priority_text")).alias("name")).agg(F.count_distinct("priority_text").alias("spellings"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg(CAST({c} AS DOUBLE)), 3) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 3) AS deviation, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS greatest FROM lineitem" for c in ("l_quantity", "l_linenumber")))
def numeric_summary(spark, sf_dir):
    return quality.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_linenumber"])


_GROUP = f"list_extract(['Suspected','Confirmed','Former','','Confirmed','Suspected','Suspected','Former','Former','Former','Confirmed',''], CAST({_K} % 12 AS INT) + 1)"
#: name -> (of the typed rows, of the clean columns)
METRICS = {
    "rows": ("count(*)", "count(*)"), "distinct ids": ("count(DISTINCT id)", f"count(DISTINCT {_ID})"), "distinct people": ("count(DISTINCT o_custkey)", "count(DISTINCT o_custkey)"), "id total": ("sum(id)", f"sum({_ID})"),
    "ids missing": ("count(*) - count(id)", f"count(*) - count({_ID})"), "dates missing": ("count(*) - count(order_date)", f"count(*) - count({_DATE})"),
    "earliest date": ("min(year(order_date) * 10000 + month(order_date) * 100 + day(order_date))", f"min(year({_DATE}) * 10000 + month({_DATE}) * 100 + day({_DATE}))"),
    "latest date": ("max(year(order_date) * 10000 + month(order_date) * 100 + day(order_date))", f"max(year({_DATE}) * 10000 + month({_DATE}) * 100 + day({_DATE}))"),
    "two-digit years": ("sum(CASE WHEN date_text RLIKE '^[0-9]+/[0-9]+/[0-9]{2}$' THEN 1 ELSE 0 END)", f"sum(CASE WHEN {_K} % 9 = 1 AND {_K} % 61 <> 0 AND {_K} % 67 <> 0 THEN 1 ELSE 0 END)"),
    "money missing": ("count(*) - count(money)", f"count(*) - count({_MONEY})"), "total money": ("sum(money)", f"sum({_MONEY})"), "negative money": ("sum(CASE WHEN money < 0 THEN 1 ELSE 0 END)", f"sum(CASE WHEN {_MONEY} < 0 THEN 1 ELSE 0 END)"),
    "greatest money": ("max(money)", f"max({_MONEY})"), "points missing": ("count(*) - count(points)", f"count(*) - count({_POINTS})"), "total points": ("sum(points)", f"sum({_POINTS})"),
    "times missing": ("count(*) - count(time)", f"count(*) - count({_TIME})"), "seconds of the day": ("sum(CAST(substr(time, 1, 2) AS INT) * 3600 + CAST(substr(time, 4, 2) AS INT) * 60)", f"sum(CAST(substr({_TIME}, 1, 2) AS INT) * 3600 + CAST(substr({_TIME}, 4, 2) AS INT) * 60)"),
    "flags missing": ("count(*) - count(flag)", f"count(*) - count({_FLAG})"), "flags true": ("sum(CASE WHEN flag THEN 1 ELSE 0 END)", f"sum(CASE WHEN {_FLAG} THEN 1 ELSE 0 END)"), "priorities unmapped": ("sum(CASE WHEN priority IS NULL THEN 1 ELSE 0 END)", f"sum(CASE WHEN {_PRIORITY} IS NULL THEN 1 ELSE 0 END)"),
    "distinct priorities": ("count(DISTINCT priority)", f"count(DISTINCT {_PRIORITY})"), "confirmed groups": ("sum(CASE WHEN status = 'Confirmed' THEN 1 ELSE 0 END)", f"sum(CASE WHEN {_K} % 79 <> 0 AND {_GROUP} = 'Confirmed' THEN 1 ELSE 0 END)"),
}


@query("WITH o AS (SELECT * FROM orders) " + " UNION ALL ".join(f"SELECT '{n}' AS metric, CAST({c} AS DECIMAL(38,3)) AS left_side, CAST({c} AS DECIMAL(38,3)) AS right_side, TRUE AS agrees FROM o" for n, (_, c) in METRICS.items()))
def recon_metrics(spark, sf_dir):
    """22 metrics of the cleansed texts against the same of the clean columns, each side in one scan."""
    status = text.group_status(text.domain_key(F.col("group_text")))[1]
    ref = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().withColumn("source_value", text.domain_key(F.col("o_orderpriority")))
    rows = quality.crosswalk(_clean(spark, sf_dir), ref, text.domain_key(F.col("priority_text")), "source_value", {"o_orderpriority": "priority"}).withColumn("status", status)
    left = rows.agg(*[F.expr(a).alias(n) for n, (a, _) in METRICS.items()])
    clean = {n: c.replace("VARCHAR", "STRING").replace("list_extract([", "element_at(array(").replace("'Confirmed',''],", "'Confirmed',''),") for n, (_, c) in METRICS.items()}
    right = table(spark, sf_dir, "orders").agg(*[F.expr(c).alias(n) for n, c in clean.items()])
    return quality.reconcile(left, right)


