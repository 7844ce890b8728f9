"""Registered queries over the driver tables, each with SQL that states the expected result from the clean columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import convert, dates, text
from ..operators import govern, quality, search
from ..operators import learning as ml
from ..streaming import pipeline
from .base import _DATE, _FLAG, _ID, _K, _MONEY, _POINTS, _PRIORITY, _TIME, AS_OF, ORACLE_SQL, QUERIES, _clean, folder, query
from .messy import messy_orders, table

@query(f"SELECT {_K} AS k, {_ID} AS id, {_DATE} AS order_date, {_MONEY} AS money, {_POINTS} AS points, {_TIME} AS time, {_FLAG} AS flag FROM orders")
def all_conversions(spark, sf_dir):
    return _clean(spark, sf_dir).select("k", "id", "order_date", "money", "points", "time", "flag")


@query(f"""SELECT n_name AS unit_name, count(*) AS records, count(DISTINCT o_custkey) AS people,
 count(*) FILTER (WHERE flag) AS flagged, CAST(sum(money) AS DECIMAL(22,2)) AS owed FROM
 (SELECT o_custkey, {_ID} AS id, {_FLAG} AS flag, {_MONEY} AS money FROM orders) o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 WHERE id IS NOT NULL GROUP BY n_name""")
def people_by_unit(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = _clean(spark, sf_dir).where("id IS NOT NULL").join(people, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("n_name").alias("unit_name")).agg(F.count("*").alias("records"), F.count_distinct("o_custkey").alias("people"), F.count_if("flag").alias("flagged"), F.sum("money").alias("owed"))


_PERSON = f"CASE WHEN ({_K} + o_custkey) % 71 = 0 THEN NULL WHEN {_K} % 73 = 0 THEN lpad(CAST(o_custkey + 1 AS VARCHAR), 7, '0') ELSE lpad(CAST(o_custkey + 1 AS VARCHAR), 8, '0') END"


@query(f"""SELECT {_K} AS k, CASE WHEN {_K} % 97 = 0 THEN 'not 8 digits' WHEN {_K} % 89 = 0 THEN 'missing' WHEN length({_PERSON}) = 7 THEN 'second ID not 8 digits' END AS id_problem,
 lpad(CAST({_ID} AS VARCHAR), 8, '0') AS padded FROM orders""")
def id_problems(spark, sf_dir):
    rows = _clean(spark, sf_dir)
    return rows.select("k", convert.id_problem(F.col("id_text"), F.col("person_text")).alias("id_problem"), text.pad_id(F.col("id")).alias("padded"))


@query(f"""WITH o AS (SELECT {_ID} AS id, {_K} % 89 = 0 AND {_K} % 97 <> 0 AS missing, {_K} % 97 = 0 AS bad, {_PERSON} AS person, o_orderpriority AS name FROM orders),
 p AS (SELECT person, count(DISTINCT name) AS names, count(*) AS records FROM o WHERE person IS NOT NULL GROUP BY person)
 SELECT 'id missing' AS check_name, count(*) FILTER (WHERE missing) AS n FROM o UNION ALL SELECT 'id invalid', count(*) FILTER (WHERE bad) FROM o UNION ALL SELECT 'id repeated', count(id) - count(DISTINCT id) FROM o
 UNION ALL SELECT 'person missing', count(*) FILTER (WHERE person IS NULL) FROM o UNION ALL SELECT 'person invalid', count(*) FILTER (WHERE length(person) = 7) FROM o
 UNION ALL SELECT 'people with conflicting names', count(*) FILTER (WHERE names > 1) FROM p UNION ALL SELECT 'people with several records', count(*) FILTER (WHERE records > 1) FROM p""")
def key_checks(spark, sf_dir):
    return quality.key_checks(_clean(spark, sf_dir), "id_text", "person_text", "o_orderpriority")


@query(f"""SELECT CASE WHEN {_K} % 61 = 0 THEN 'MM/DD/YYYY' ELSE list_extract(['MM/DD/YYYY','M/D/YY','MM-DD-YYYY','YYYY-MM-DD','YYYY-MM-DD HH:MM:SS','YYYYMMDD','DD-MON-YYYY','Month D, YYYY','Mon D YYYY'], CAST({_K} % 9 AS INT) + 1) END AS format,
 count(*) AS n FROM orders WHERE NOT ({_K} % 67 = 0 AND {_K} % 61 <> 0) GROUP BY 1""")
def classify_formats(spark, sf_dir):
    rows = _clean(spark, sf_dir).where("date_text IS NOT NULL")
    label = dates.date_format_of(F.col("date_text"))
    return rows.groupBy(label.alias("format")).agg(F.count("*").alias("n"))


@query(f"""SELECT 'date_text' AS column_name, count(*) FILTER (WHERE {_K} % 67 = 0 AND {_K} % 61 <> 0) AS missing, count(*) FILTER (WHERE {_K} % 61 = 0) AS failed,
 count(*) FILTER (WHERE {_K} % 61 <> 0 AND {_K} % 67 <> 0) AS converted, count(*) FILTER (WHERE {_K} % 9 = 1 AND {_K} % 61 <> 0 AND {_K} % 67 <> 0) AS two_digit,
 count(*) FILTER (WHERE {_K} % 9 = 1 AND {_K} % 61 <> 0 AND {_K} % 67 <> 0 AND year(o_orderdate) < 2000) AS century_corrected FROM orders""")
def date_report(spark, sf_dir):
    rows, raw = _clean(spark, sf_dir), F.col("date_text")
    two = raw.rlike(dates.TWO_DIGITS)
    return rows.agg(F.lit("date_text").alias("column_name"), F.count_if(raw.isNull()).alias("missing"), F.count_if(convert.failed(raw, F.col("order_date"))).alias("failed"), F.count("order_date").alias("converted"), F.count_if(two & F.col("order_date").isNotNull()).alias("two_digit"), F.count_if(two & (F.year("order_date") < 2000)).alias("century_corrected"))


@query(f"""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship_date, CAST(date_diff('year', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))
 - CASE WHEN strftime(l_shipdate, '%m%d') < strftime(o_orderdate, '%m%d') THEN 1 ELSE 0 END AS INT) AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate""")
def century_after(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.where("l_shipdate >= o_orderdate").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "M/d/yy").alias("raw"), F.col("o_orderdate").cast("date").alias("ordered"))
    found = dates.resolve(rows, {}, {"ship_date": ("raw", "ordered")}, F.lit(AS_OF).cast("date"))
    return found.select("l_orderkey", "l_linenumber", "ship_date", dates.age_years(F.col("ordered"), F.col("ship_date")).alias("age"))


_BORN = f"CAST({_DATE} + to_years(CAST(30 - {_K} % 160 AS INT)) AS DATE)"
_AGE = f"(2026 - year({_BORN}) - CASE WHEN strftime({_BORN}, '%m%d') > '0101' THEN 1 ELSE 0 END)"


@query(f"""SELECT {_K} AS k, CASE WHEN year({_BORN}) < 1900 THEN 'before 1900' WHEN {_BORN} > DATE '2026-01-01' THEN 'in the future' WHEN {_AGE} < 17 THEN 'under 17' WHEN {_AGE} > 100 THEN 'over 100' END AS flag FROM orders""")
def date_flags(spark, sf_dir):
    """Birth dates from 1863 to 2028: every flag occurs."""
    on = F.lit(AS_OF).cast("date")
    rows = _clean(spark, sf_dir).select("k", F.expr("add_months(order_date, CAST(12 * (30 - k % 160) AS INT))").alias("born"))
    return rows.select("k", dates.birth_flag(F.col("born"), dates.age_years(F.col("born"), on), on).alias("flag"))


@query(f"""SELECT {_K} AS k, {_DATE} AS sentenced, CASE WHEN {_DATE} IS NOT NULL THEN CAST({_DATE} + to_years(CAST({_K} % 40 AS INT)) AS DATE) END AS released,
 CAST(year({_DATE}) - 1970 - CASE WHEN strftime({_DATE}, '%m%d') < '0301' THEN 1 ELSE 0 END AS INT) AS age FROM orders""")
def session_dates(spark, sf_dir):
    """Three date columns in one step: a birth date that is typed, one of the past, and one after it that is written with two digits."""
    rows = text.strip_and_null(messy_orders(spark, sf_dir))
    known = F.when(F.col("date_text") != "02/30/2020", F.expr("add_months(d, CAST(12 * (k % 40) AS INT))"))
    rows = rows.join(table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("k"), F.col("o_orderdate").cast("date").alias("d")), "k").withColumn("release_text", F.date_format(known, "M/d/yy"))
    found = dates.resolve(rows, {"sentenced": "date_text"}, {"released": ("release_text", "sentenced")}, F.lit(AS_OF).cast("date"))
    return found.select("k", "sentenced", "released", dates.age_years(F.lit("1970-03-01").cast("date"), F.col("sentenced")).alias("age"))


@query("""SELECT shape, count(*) AS n, min(v) AS example FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS v, '9999-99-99' AS shape FROM orders
 UNION ALL SELECT o_orderpriority, regexp_replace(regexp_replace(o_orderpriority, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') FROM orders) GROUP BY shape ORDER BY n DESC, shape LIMIT 15""")
def shape_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("v")).union(o.select("o_orderpriority"))
    return v.groupBy(dates.shape(F.col("v")).alias("shape")).agg(F.count("*").alias("n"), F.min("v").alias("example")).orderBy(F.desc("n"), "shape").limit(15)


@query(f"SELECT {_K} AS k, o_custkey, {_DATE} AS order_date FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT {_DATE}) > 1)")
def date_conflicts(spark, sf_dir):
    """The rows of people with several dates."""
    rows = _clean(spark, sf_dir).select("k", "o_custkey", "order_date")
    several = rows.groupBy("o_custkey").agg(F.count_distinct("order_date").alias("dates")).where("dates > 1")
    return quality.rows_of(rows, several, "o_custkey").select("k", "o_custkey", "order_date")


@query(f"SELECT CAST(month({_DATE}) AS INT) AS month, CAST(sum({_MONEY}) AS DECIMAL(22,2)) AS spent FROM orders WHERE {_DATE} IS NOT NULL GROUP BY 1")
def spend_by_month(spark, sf_dir):
    return _clean(spark, sf_dir).where("order_date IS NOT NULL").groupBy(F.month("order_date").alias("month")).agg(F.sum("money").alias("spent"))


def _coded(spark, sf_dir):
    rows = _clean(spark, sf_dir)
    ref = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().withColumn("source_value", text.domain_key(F.col("o_orderpriority")))
    return quality.crosswalk(rows, ref, text.domain_key(F.col("priority_text")), "source_value", {"o_orderpriority": "priority"})


@query(f"SELECT {_K} AS k, {_PRIORITY} AS priority FROM orders")
def crosswalk_join(spark, sf_dir):
    return _coded(spark, sf_dir).select("k", "priority")


def _parts():
    return [("priority_text", F.col("priority_text"), F.col("priority_text").isNotNull() & F.col("priority").isNull(), "not in the crosswalk"),
            ("group_text", F.col("group_text"), F.col("group_text").contains("/"), "two groups in one cell")]


@query(f"""SELECT {_K} AS k, 'priority_text' AS "column", 'XX' AS value_as_written, 'not in the crosswalk' AS reason FROM orders WHERE {_K} % 83 = 0
 UNION ALL SELECT {_K}, 'group_text', 'A/B', 'two groups in one cell' FROM orders WHERE {_K} % 79 = 0""")
def domain_exceptions(spark, sf_dir):
    return quality.exceptions(_coded(spark, sf_dir), "k", _parts())


@query(f"""SELECT "column", reason, value_as_written, count(*) AS n FROM (SELECT 'priority_text' AS "column", 'not in the crosswalk' AS reason, 'XX' AS value_as_written FROM orders WHERE {_K} % 83 = 0
 UNION ALL SELECT 'group_text', 'two groups in one cell', 'A/B' FROM orders WHERE {_K} % 79 = 0) GROUP BY ALL""")
def exceptions_top(spark, sf_dir):
    found = quality.exceptions(_coded(spark, sf_dir), "k", _parts()).groupBy("column", "reason", "value_as_written").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "column", "value_as_written").limit(15)


_FAILED = (("date_text", "order_date"), ("money_text", "money"), ("points_text", "points"), ("time_text", "time"), ("flag_text", "flag"))


@query(" UNION ALL ".join(f"SELECT {_K} AS k, '{c}' AS \"column\", '{v}' AS value_as_written FROM orders WHERE {_K} % {m} = 0" for c, v, m in (("date_text", "02/30/2020", 61), ("money_text", "TBD", 53), ("points_text", "2.5", 47), ("time_text", "25:10", 43), ("flag_text", "?", 41))))
def conversion_exceptions(spark, sf_dir):
    parts = [(c, F.col(f"as_written.{c}"), convert.failed(F.col(f"as_written.{c}"), F.col(v)), "") for c, v in _FAILED]
    return quality.exceptions(_clean(spark, sf_dir), "k", parts).drop("reason")


@query(f"""SELECT {_K} AS k, CASE WHEN {_K} % 79 = 0 THEN 'A/B' WHEN {_K} % 12 = 11 THEN 'NONE' ELSE 'ALPHA' END AS grp, CASE WHEN {_K} % 79 = 0 THEN NULL
 ELSE list_extract(['Suspected','Confirmed','Former','Unverified','Confirmed','Suspected','Suspected','Former','Former','Former','Confirmed','None'], CAST({_K} % 12 AS INT) + 1) END AS status FROM orders""")
def split_group_status(spark, sf_dir):
    group, status = text.group_status(text.domain_key(F.col("group_text")))
    status = F.coalesce(status, F.when(group == "NONE", "None").when(group == "ALPHA", "Unverified"))
    return _clean(spark, sf_dir).select("k", group.alias("grp"), status.alias("status"))


@query(f"SELECT {_K} AS k, list_extract(['it works','it works','\"it works\"','it isn''t','it works','MUÑOZ - x y','José & \"Má\"',NULL], CAST({_K} % 8 AS INT) + 1) AS note FROM orders")
def repair_notes(spark, sf_dir):
    return messy_orders(spark, sf_dir).select("k", text.repair_text(F.col("damaged_note")).alias("note"))


@query("SELECT 'damaged notes' AS check_name, count(*) AS n FROM orders UNION ALL SELECT 'sound notes', 0")
def repaired_values(spark, sf_dir):
    rows = messy_orders(spark, sf_dir)
    return quality.changed(rows, {n: (F.col(c), text.repair_text(F.col(c))) for n, c in (("damaged notes", "damaged_note"), ("sound notes", "note"))})


@query("SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def fold_names_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold_accents(F.col("text"))).alias("folded"))


_SAID = (("mcDONALD jr.", "McDonald Jr"), ("de LA cruz", "de la Cruz"), ("o''neil", "O''Neil"), ("smith-jones iii", "Smith-Jones III"), ("macdonald", "MacDonald"), ("van  dyke", "van Dyke"), ("mc lee", "Mc Lee"))


@query("SELECT c_custkey, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || list_extract([" + ", ".join(f"'{b}'" for _, b in _SAID) + "], CAST(c_custkey % 7 AS INT) + 1) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def display_names_nation(spark, sf_dir):
    """The customers' nations as first names, before last names of every kind."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    last = F.element_at(F.array(*[F.lit(a.replace("''", "'")) for a, _ in _SAID]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return c.select("c_custkey", text.display_name(F.concat_ws(" ", F.lower("n_name"), last)).alias("name"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS event_type FROM events")
def null_tokens_events(spark, sf_dir):
    return text.null_tokens(table(spark, sf_dir, "events").select("event_id", "event_type"), {"event_type": ["VIEW"]})


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


_PROFILE = "count(*) AS rows, count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*), 5) AS null_share, count(DISTINCT {c}) AS distinct_values, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest, {m} AS median"


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, {_PROFILE.format(c=c, m=m)} FROM customer" for c, m in (("c_mktsegment", "NULL"), ("c_name", "NULL"), ("c_nationkey", "quantile_cont(CAST(c_nationkey AS DOUBLE), 0.5)"))))
def profile_columns(spark, sf_dir):
    return quality.profile(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_name", "c_nationkey"], exact=True)


@query(f"""SELECT o_custkey AS person, string_agg(DISTINCT o_orderpriority, '/' ORDER BY o_orderpriority) AS codes FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1""")
def conflict_list(spark, sf_dir):
    return quality.conflicts(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "person"), "person", "o_orderpriority", ["5-LOW"])


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O') AND (o_orderstatus = 'F') <> (l_linestatus = 'F')")
def cross_column_conflicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").where(F.col("o_orderstatus").isin("F", "O"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.where((F.col("o_orderstatus") == "F") != (F.col("l_linestatus") == "F")).drop("o_orderkey")


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY l_returnflag")
def crosstab(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query(f"SELECT o_orderstatus, round(avg({_POINTS}), 4) AS mean_points, CAST(sum({_MONEY}) AS DECIMAL(22,2)) AS owed, round(avg(CASE WHEN {_FLAG} THEN 1.0 WHEN NOT {_FLAG} THEN 0.0 END), 4) AS flag_share FROM orders GROUP BY o_orderstatus")
def grouped_measures(spark, sf_dir):
    return _clean(spark, sf_dir).groupBy("o_orderstatus").agg(F.round(F.avg("points"), 4).alias("mean_points"), F.sum("money").alias("owed"), F.round(F.avg(F.col("flag").cast("double")), 4).alias("flag_share"))


_RULES = {"id present": ("id IS NOT NULL", f"{_ID} IS NULL"), "date present": ("order_date IS NOT NULL", f"{_DATE} IS NULL"), "money not negative": ("money IS NULL OR money >= 0", f"{_MONEY} < 0")}


@query(" UNION ALL ".join(f"SELECT count(*) AS records, '{n}' AS check_name, count(*) FILTER (WHERE {bad}) AS failing_records, round(count(*) FILTER (WHERE {bad}) / count(*), 5) AS failing_share FROM orders" for n, (_, bad) in _RULES.items()))
def quality_summary(spark, sf_dir):
    return quality.summary(_clean(spark, sf_dir), {n: good for n, (good, _) in _RULES.items()})


@query(f"""SELECT 'ids' AS metric, CAST(sum({_ID}) AS DECIMAL(38,2)) AS left_side, CAST(sum({_ID}) AS DECIMAL(38,2)) AS right_side, TRUE AS agrees FROM orders
 UNION ALL SELECT 'money', CAST(sum({_MONEY}) AS DECIMAL(38,2)), CAST(sum({_MONEY}) AS DECIMAL(38,2)), TRUE FROM orders""")
def reconcile(spark, sf_dir):
    def metrics(rows, name):
        one = rows.agg(F.sum("id").cast("decimal(38,2)").alias("ids"), F.sum("money").cast("decimal(38,2)").alias("money"))
        return quality.long_form(one, "metric", name)

    rows = _clean(spark, sf_dir)
    again = rows.select(F.coalesce("id", F.lit(0)).alias("id"), F.coalesce("money", F.lit(0)).alias("money")).groupBy("id").agg(F.sum("money").alias("money"))
    both = metrics(rows, "left_side").join(metrics(again, "right_side"), "metric", "full_outer")
    return both.withColumn("agrees", F.col("left_side").eqNullSafe(F.col("right_side")))


@query(f"""WITH o AS (SELECT * FROM orders) SELECT 'rows with a usable date' AS question, 0 + count(*) FILTER (WHERE {_K} % 61 <> 0 AND {_K} % 67 <> 0 AND {_K} % 9 IN (3, 4)) AS naive, count({_DATE}) AS typed,
 count(*) FILTER (WHERE {_K} % 61 <> 0 AND {_K} % 67 <> 0 AND {_K} % 9 IN (3, 4)) <> count({_DATE}) AS changed FROM o
 UNION ALL SELECT 'flagged rows', count(*) FILTER (WHERE {_K} % 41 <> 0 AND {_K} % 15 = 0), count(*) FILTER (WHERE {_FLAG}), count(*) FILTER (WHERE {_K} % 41 <> 0 AND {_K} % 15 = 0) <> count(*) FILTER (WHERE {_FLAG}) FROM o""")
def trust_scorecard(spark, sf_dir):
    rows = _clean(spark, sf_dir)
    naive = quality.long_form(rows.agg(F.count(F.when(F.col("date_text").rlike(r"^\d{4}-"), F.col("date_text").try_cast("date"))).alias("rows with a usable date"), F.count_if(F.col("flag_text") == "Y").alias("flagged rows")), "question", "naive")
    typed = quality.long_form(rows.agg(F.count("order_date").alias("rows with a usable date"), F.count_if("flag").alias("flagged rows")), "question", "typed")
    return naive.join(typed, "question").withColumn("changed", F.col("naive") != F.col("typed"))


@query("SELECT p_partkey, trim(unnest(string_split(p_name || ' ' || p_type, ' '))) AS word FROM part")
def explode_packed(spark, sf_dir):
    packed = F.concat_ws("; ", F.split("p_name", " "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(packed, ";")).alias("word")).select("p_partkey", F.trim("word").alias("word"))


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderpriority >= '3' GROUP BY 1")
def ordered_codes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return o.where(convert.rank_of(F.col("o_orderpriority"), order) >= 3).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 3")
def head_per_group(spark, sf_dir):
    return quality.first_per_value(table(spark, sf_dir, "events"), "event_type", "event_id", 3).select("event_type", "event_id")


@query("SELECT text, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    """Repeated texts, told apart by a digest, so that only the first of each is read for its text."""
    docs = table(spark, sf_dir, "documents")
    found = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1").drop("digest")
    return docs.join(found, F.col("doc_id") == F.col("first_id")).select("text", "n", "first_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def topk_values(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '-7'), doc_id LIMIT 50")
def hash_sample(spark, sf_dir):
    return ml.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id FROM events WHERE hour(ts) >= 22 OR hour(ts) < 6")
def overnight_events(spark, sf_dir):
    return table(spark, sf_dir, "events").where((F.hour("ts") >= 22) | (F.hour("ts") < 6)).select("event_id")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), w AS (SELECT day, n, avg(n) OVER t AS m, stddev_samp(n) OVER t AS s, day - lag(day) OVER (ORDER BY day) AS gap FROM d WINDOW t AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
 SELECT day, n, round(m, 4) AS trailing_mean, round(s, 4) AS trailing_deviation, coalesce(abs(n - m) > 3 * s, FALSE) AS unusual, CAST(gap AS INT) AS days_since FROM w""")
def completeness_watch(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    trailing = Window.orderBy("day").rowsBetween(-7, -1)  # one row a day
    d = d.withColumns({"m": F.avg("n").over(trailing), "s": F.stddev_samp("n").over(trailing), "days_since": F.datediff("day", F.lag("day").over(Window.orderBy("day")))})
    return d.select("day", "n", F.round("m", 4).alias("trailing_mean"), F.round("s", 4).alias("trailing_deviation"), F.coalesce(F.abs(F.col("n") - F.col("m")) > 3 * F.col("s"), F.lit(False)).alias("unusual"), "days_since")


def _access(spark, sf_dir):
    """Readers of units: each nation is read by the reader of its region."""
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("reader "), F.col("n_regionkey").cast("string")).alias("reader"), F.col("n_nationkey").alias("unit"))


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey IN (1, 2, 3) THEN 'RESTRICTED' ELSE c_name END AS c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def masked_view(spark, sf_dir):
    seen = govern.row_filter(table(spark, sf_dir, "customer"), _access(spark, sf_dir), "c_nationkey", "reader 1")
    return seen.select("c_custkey", "c_nationkey", govern.mask(F.col("c_name"), ~F.col("c_nationkey").isin(1, 2, 3)).alias("c_name"))


@query("SELECT c_custkey, c_nationkey, 'RESTRICTED' AS c_name, c_name AS seen FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def sql_masked_view(spark, sf_dir):
    """The mask and the unit filter as SQL functions, used in a query that any reader can write."""
    tag = uuid.uuid4().hex
    _access(spark, sf_dir).createOrReplaceTempView(f"access_{tag}")
    table(spark, sf_dir, "customer").createOrReplaceTempView(f"people_{tag}")
    govern.create_mask(spark, f"mask_{tag}", ["auditors"])
    govern.create_unit_filter(spark, f"units_{tag}", f"access_{tag}")
    return spark.sql(f"""SELECT c_custkey, c_nationkey, mask_{tag}(c_name, array('clerks')) AS c_name, mask_{tag}(c_name, array('clerks', 'auditors')) AS seen
     FROM people_{tag} WHERE c_nationkey IN (SELECT unit FROM units_{tag}('reader 1'))""")


@query("SELECT c_custkey AS customer, 'RESTRICTED' AS name, c_mktsegment AS segment FROM customer")
def published_view(spark, sf_dir):
    return govern.published(table(spark, sf_dir, "customer"), {"c_custkey": "customer", "c_name": "name", "c_mktsegment": "segment"}, ["c_name"])


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 5, 7, 9) ORDER BY c_custkey LIMIT 200")
def practice_subset(spark, sf_dir):
    return govern.practice(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", [1, 5, 7, 9], "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def unreviewed_anti(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(r, "o_orderkey", "left_anti")


_NOTE_TRUE = f"({_K} % 10 IN (0, 9))"


@query(f"SELECT {_K} AS k, {_K} % 10 IN (0, 2, 8, 9) AS words, {_K} % 10 IN (0, 9) AS negated, {_K} % 10 IN (1, 3, 4, 6) AS lemma FROM orders")
def lexicon_negation(spark, sf_dir):
    note, words = F.col("note"), ["helpful", "cooperative"]
    return messy_orders(spark, sf_dir).select("k", search.lexicon(note, words).alias("words"), search.lexicon(note, words, ["no", "not", "never"], 3).alias("negated"), search.lexicon(note, ["good"], lemmas={"better": "good"}).alias("lemma"))


@query(f"""WITH t AS (SELECT 'lexicon' AS name, {_K} % 10 IN (0, 2, 8, 9) AS p, {_NOTE_TRUE} AS t FROM orders UNION ALL SELECT 'best', {_NOTE_TRUE}, {_NOTE_TRUE} FROM orders),
 c AS (SELECT name, count(*) FILTER (WHERE p) AS returned, count(*) FILTER (WHERE p AND t) AS correct, count(*) FILTER (WHERE p AND NOT t) AS wrong, count(*) FILTER (WHERE NOT p AND t) AS missed FROM t GROUP BY name)
 SELECT name, returned, correct, wrong, missed, round(correct / returned, 3) AS precision, round(correct / (correct + missed), 3) AS recall, round(2.0 * correct / (2 * correct + wrong + missed), 3) AS f1 FROM c""")
def scoreboard(spark, sf_dir):
    note, words = F.col("note"), ["helpful", "cooperative"]
    return quality.score(messy_orders(spark, sf_dir), {"lexicon": search.lexicon(note, words), "best": search.lexicon(note, words, ["no", "not", "never"], 3)}, F.expr("k % 10 IN (0, 9)"))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), e AS (SELECT min(vec_id) AS vec_id, embedding FROM embeddings GROUP BY embedding), s AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))) AS s
 FROM e, q ORDER BY s DESC, vec_id LIMIT 10) SELECT vec_id, round(s, 6) AS similarity FROM s""")
def semantic_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return search.semantic_topk(e, e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q")), "vec_id", "embedding", 10, once="embedding")


@query(f"SELECT {_K} AS k, {_ID} AS id FROM orders")
def csv_round_trip(spark, sf_dir):
    path = folder(spark)
    messy_orders(spark, sf_dir).select("k", "id_text").write.option("header", True).csv(path)
    raw = spark.read.schema("k string, id_text string").option("header", True).option("escape", '"').csv(path)
    return text.strip_and_null(raw).select(F.col("k").cast("long").alias("k"), convert.to_id(F.col("id_text")).alias("id"))


def _delivered(spark, sf_dir, out):
    """Events as a delivered CSV under ``out``; every 97th ID is not padded."""
    sent = table(spark, sf_dir, "events").selectExpr("CASE WHEN (event_id + 1) % 97 = 0 THEN CAST(event_id AS STRING) ELSE lpad(CAST(event_id + 1 AS STRING), 8, '0') END AS id", "CAST(ts AS STRING) AS ts", "event_type", "CAST(value AS STRING) AS value")
    sent.write.option("header", True).csv(f"{out}/landing")
    pipeline.bronze(spark, f"{out}/landing", out, ["id", "ts", "event_type", "value"])


def _to_silver(spark, out):
    pipeline.silver(spark, out, "id", lambda d: d.withColumn("id", convert.to_id(F.col("id"))), {"value present": "value IS NOT NULL"}, {"layout": "_rescued_data IS NULL"})


@query("SELECT 'silver' AS part, count(*) FILTER (WHERE (event_id + 1) % 97 <> 0) AS n FROM events UNION ALL SELECT 'quarantine', count(*) FILTER (WHERE (event_id + 1) % 97 = 0) FROM events UNION ALL SELECT 'bronze', count(*) FROM events UNION ALL SELECT 'failed checks', CAST(count(*) FILTER (WHERE (event_id + 1) % 97 = 0) > 0 AS BIGINT) FROM events")
def bronze_silver_stream(spark, sf_dir):
    """One delivery; that its quarantine is not reviewed is the one failed check."""
    out = folder(spark)
    _delivered(spark, sf_dir, out)
    _to_silver(spark, out)
    failed = pipeline.validate(spark, out, "id", {"value present": 0.05}, raises=False).where("status = 'FAIL'").agg(F.lit("failed checks").alias("part"), F.count("*").alias("n"))
    sizes = [pipeline.read(spark, out, x).agg(F.lit(x).alias("part"), F.count("*").alias("n")) for x in ("silver", "quarantine", "bronze")]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).unionByName(failed)


@query("""SELECT CAST(event_id AS VARCHAR) AS id, event_id % 2 = 0 AS reviewed FROM events WHERE (event_id + 1) % 97 = 0""")
def quarantine_reviews(spark, sf_dir):
    """Quarantine after a full refresh, half of it reviewed, twice over."""
    out = folder(spark)
    _delivered(spark, sf_dir, out)
    _to_silver(spark, out)
    pipeline.full_refresh(spark, out)
    _to_silver(spark, out)
    held = pipeline.read(spark, out, "quarantine")
    done = held.where("CAST(id AS BIGINT) % 2 = 0").select("_source_file", F.col("id").alias("id_written"), F.lit("known sender").alias("note"))
    pipeline.review(spark, out, done)
    pipeline.review(spark, out, done)
    left, seen = pipeline.unreviewed(spark, out, "id"), spark.read.parquet(f"{out}/reviews")
    return left.select("id", F.lit(False).alias("reviewed")).unionByName(seen.select(F.col("id_written").alias("id"), F.lit(True).alias("reviewed")))


from . import learning, reports, storage, streams  # noqa: E402, F401 -- they register their queries

__all__ = ["ORACLE_SQL", "QUERIES"]
