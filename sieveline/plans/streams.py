"""Registered queries over two deliveries of messy orders: bronze, silver with crosswalks, quarantine, gold and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convert, text
from ..operators import quality
from ..sources import tables
from ..sources.shared import Files
from ..streaming import events, pipeline, rescue
from .base import _DATE, _FLAG, _K, _MONEY, _P, _POINTS, _PRIORITY, _TIME, ORACLE_SQL, TEXTS, folder, query, typed
from .messy import messy_orders, table

COLUMNS = ["k", "o_custkey", "o_orderstatus", "id_text", "person_text", *TEXTS, "priority_text", "group_text"]
_PERSON_BAD = f"(({_K} + o_custkey) % 71 <> 0 AND {_K} % 73 = 0)"
_HELD = f"({_K} % 97 = 0 OR {_K} % 89 = 0 OR {_PERSON_BAD})"
_GOOD = f"orders WHERE NOT {_HELD}"
_STATUS = f"CASE WHEN {_K} % 79 = 0 THEN NULL ELSE list_extract(['Suspected','Confirmed','Former',NULL,'Confirmed','Suspected','Suspected','Former','Former','Former','Confirmed',NULL], CAST({_K} % 12 AS INT) + 1) END"

#: Warn rule -> (SQL over silver, SQL over the clean columns for its failures).
RULES = {
    **{f"{v} converted": (f"as_written.{t} IS NULL OR {v} IS NOT NULL", f"{_K} % {m} = 0") for (t, v), m in zip(TEXTS.items(), (61, 53, 47, 43, 41))},
    "date present": ("order_date IS NOT NULL", f"{_DATE} IS NULL"), "money present": ("money IS NOT NULL", f"{_MONEY} IS NULL"), "time present": ("time IS NOT NULL", f"{_TIME} IS NULL"),
    "money not negative": ("money IS NULL OR money >= 0", f"{_MONEY} < 0"), "points at most ten": ("points IS NULL OR points <= 10", "FALSE"), "priority in the crosswalk": ("priority IS NOT NULL", f"{_PRIORITY} IS NULL"),
    "one group in a cell": ("NOT contains(group_text, '/')", f"{_K} % 79 = 0"), "person present": ("person_text IS NOT NULL", f"({_K} + o_custkey) % 71 = 0"), "flag and status agree": ("flag IS NULL OR flag = (o_orderstatus = 'F')", f"{_FLAG} IS NOT NULL AND {_FLAG} <> (o_orderstatus = 'F')"),
}


def _views():
    parts = [("priority_text", F.col("priority_text"), F.col("priority").isNull(), "not in the crosswalk"), ("group_text", F.col("group_text"), F.col("group_text").contains("/"), "two groups in one cell")]
    failed = [(t, F.col(f"as_written.{t}"), convert.failed(F.col(f"as_written.{t}"), F.col(v)), "") for t, v in TEXTS.items()]
    return {
        "domain_exceptions": lambda s: quality.exceptions(s, "id", parts),
        "conversion_exceptions": lambda s: quality.exceptions(s, "id", failed).drop("reason"),
        "cross_column_conflicts": lambda s: s.where("flag <> (o_orderstatus = 'F')").select("id", "o_orderstatus", "flag"),
        "code_conflicts": lambda s: quality.conflicts(s, "o_custkey", "priority", ["5-LOW"]),
        "people_by_unit": lambda s: s.groupBy("priority").agg(F.count("*").alias("records"), F.count_distinct("o_custkey").alias("people"), F.count_if(F.col("status") == "Confirmed").alias("confirmed"), F.count_if("flag").alias("flagged")),
        "quality_summary": lambda s: quality.summary(s, {n: r for n, (r, _) in RULES.items()}).withColumn("computed_at", F.current_timestamp()),
    }


_DONE: dict[tuple, str] = {}


def _by_unit(rows):
    """State of people by unit: a row for each unit and person."""
    return rows.groupBy("priority", "o_custkey").agg(F.count("*").alias("records"), F.count_if(F.col("status") == "Confirmed").alias("confirmed"), F.count_if("flag").alias("flagged"))


def _merge_units(state):
    return state.groupBy("priority", "o_custkey").agg(*[F.sum(c).alias(c) for c in ("records", "confirmed", "flagged")])


def _pipeline(spark, sf_dir) -> str:
    """Folder of a pipeline that got two deliveries, each taken up by an update of its own; one for each session and state of the input's files."""
    key = (spark.sparkContext.applicationId, sf_dir, Files(spark, f"{sf_dir}/orders.parquet").state())
    if key in _DONE:
        return _DONE[key]
    out = folder(spark)
    ref = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().withColumn("source_value", text.domain_key(F.col("o_orderpriority")))
    tables.save_reference(ref, "source_value", f"{out}/priority")
    ref = tables.load_reference(spark, f"{out}/priority")

    def cleanse(d):
        rows = typed(d).withColumns({"k": F.col("k").cast("bigint"), "o_custkey": F.col("o_custkey").cast("bigint")})
        rows = quality.apply_domains(rows, [(text.domain_key(F.col("priority_text")), ref, "source_value", {"o_orderpriority": "priority"})])
        return rows.withColumn("status", text.group_status(text.domain_key(F.col("group_text")))[1])

    sent = messy_orders(spark, sf_dir).select(COLUMNS)
    for part in ("k % 3 <> 0", "k % 3 = 0"):
        sent.where(part).write.mode("append").option("header", True).option("escape", '"').csv(f"{out}/landing")
        with events.EventLog(spark, f"{out}/_events"):
            pipeline.bronze(spark, f"{out}/landing", out, COLUMNS)
            pipeline.silver(spark, out, "id_text", cleanse, {n: r for n, (r, _) in RULES.items()}, {"layout": "_rescued_data IS NULL"}, "person_text")
        pipeline.gold_incremental(spark, out, "people_by_unit", _by_unit, _merge_units)
    pipeline.gold(spark, out, _views(), {"people_by_unit": {"people do not outnumber records": "people <= records"}})
    return _DONE.setdefault(key, out)


@query(f"SELECT {_K} AS k, {_K} AS id, {_DATE} AS order_date, {_MONEY} AS money, {_POINTS} AS points, {_TIME} AS time, {_FLAG} AS flag, {_PRIORITY} AS priority, {_STATUS} AS status FROM {_GOOD}")
def silver_stream(spark, sf_dir):
    """The whole cleanse with a crosswalk, on a stream of two deliveries."""
    return pipeline.read(spark, _pipeline(spark, sf_dir), "silver").select("k", "id", "order_date", "money", "points", "time", "flag", "priority", "status")


@query(f"""SELECT {_K} AS k, CASE WHEN {_K} % 97 = 0 THEN 'not 8 digits' WHEN {_K} % 89 = 0 THEN 'missing' ELSE 'second ID not 8 digits' END AS problem FROM orders WHERE {_HELD}""")
def quarantine_stream(spark, sf_dir):
    held = pipeline.read(spark, _pipeline(spark, sf_dir), "quarantine")
    return held.select(F.col("k").cast("bigint").alias("k"), F.col("_id_problem").alias("problem"))


@query("SELECT count(*) AS n, TRUE AS several_files FROM orders")
def rows_per_file(spark, sf_dir):
    """Rows of each delivered file, summed: both deliveries are in, once."""
    by = tables.rows_per_file(pipeline.read(spark, _pipeline(spark, sf_dir), "bronze"))
    return by.agg(F.sum("n").alias("n"), (F.count("*") > 1).alias("several_files"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER (WHERE NOT coalesce({bad}, FALSE)) AS passed, count(*) FILTER (WHERE {bad}) AS failed FROM {_GOOD}" for n, (_, bad) in RULES.items()))
def expectation_counts(spark, sf_dir):
    return pipeline.expectation_counts(spark, _pipeline(spark, sf_dir))


def _gold(spark, sf_dir, name):
    return spark.read.parquet(f"{_pipeline(spark, sf_dir)}/gold/{name}")


@query(f"""SELECT {_K} AS id, 'priority_text' AS "column", 'XX' AS value_as_written, 'not in the crosswalk' AS reason FROM {_GOOD} AND {_K} % 83 = 0
 UNION ALL SELECT {_K}, 'group_text', 'A/B', 'two groups in one cell' FROM {_GOOD} AND {_K} % 79 = 0""")
def gold_domain_exceptions(spark, sf_dir):
    return _gold(spark, sf_dir, "domain_exceptions")


@query(" UNION ALL ".join(f"SELECT {_K} AS id, '{c}' AS \"column\", '{v}' AS value_as_written FROM {_GOOD} AND {_K} % {m} = 0" for c, v, m in (("date_text", "02/30/2020", 61), ("money_text", "TBD", 53), ("points_text", "2.5", 47), ("time_text", "25:10", 43), ("flag_text", "?", 41))))
def gold_conversion_exceptions(spark, sf_dir):
    return _gold(spark, sf_dir, "conversion_exceptions")


@query(f"SELECT {_K} AS id, o_orderstatus, {_FLAG} AS flag FROM {_GOOD} AND {_FLAG} <> (o_orderstatus = 'F')")
def gold_cross_column_conflicts(spark, sf_dir):
    return _gold(spark, sf_dir, "cross_column_conflicts")


@query(f"""SELECT o_custkey, string_agg(DISTINCT {_PRIORITY}, '/' ORDER BY {_PRIORITY}) AS codes FROM {_GOOD} AND {_PRIORITY} <> '5-LOW' GROUP BY o_custkey HAVING count(DISTINCT {_PRIORITY}) > 1""")
def gold_code_conflicts(spark, sf_dir):
    return _gold(spark, sf_dir, "code_conflicts")


@query(f"SELECT {_PRIORITY} AS priority, count(*) AS records, count(DISTINCT o_custkey) AS people, count(*) FILTER (WHERE {_STATUS} = 'Confirmed') AS confirmed, count(*) FILTER (WHERE {_FLAG}) AS flagged FROM {_GOOD} GROUP BY 1")
def gold_people_by_unit(spark, sf_dir):
    return _gold(spark, sf_dir, "people_by_unit")


@query(ORACLE_SQL["gold_people_by_unit"])
def incremental_people_by_unit(spark, sf_dir):
    """The same view from the state that each delivery was merged into, without reading silver again."""
    state = pipeline.gold_state(spark, _pipeline(spark, sf_dir), "people_by_unit")
    return state.groupBy("priority").agg(F.sum("records").alias("records"), F.count("o_custkey").alias("people"), F.sum("confirmed").alias("confirmed"), F.sum("flagged").alias("flagged"))


@query(" UNION ALL ".join(f"SELECT 'silver' AS dataset, '{n}' AS expectation, count(*) FILTER (WHERE NOT coalesce({bad}, FALSE)) AS passed, count(*) FILTER (WHERE {bad}) AS failed FROM {_GOOD} AND {_K} % 3 = 0" for n, (_, bad) in RULES.items()))
def event_log_metrics(spark, sf_dir):
    """What the listener wrote of the latest update, which took up the second delivery."""
    return events.expectation_metrics(events.read_events(spark, f"{_pipeline(spark, sf_dir)}/_events"))


@query(f"""WITH v AS (SELECT {_K} AS k, 1 AS delivery FROM orders WHERE {_K} % 3 <> 0 UNION ALL SELECT {_K}, 2 FROM orders WHERE {_K} % 2 = 0)
 SELECT k, CAST(min(delivery) AS INT) AS delivery, CAST(count(*) - 1 AS BIGINT) AS repeated FROM v GROUP BY k""")
def repeats_held(spark, sf_dir):
    """Two deliveries that share IDs: each ID is in silver once, from its first delivery, and its repeats are in quarantine."""
    out = folder(spark)
    rows = table(spark, sf_dir, "orders").select(F.lpad((F.col("o_orderkey") + 1).cast("string"), 8, "0").alias("id"))
    for n, part in ((1, "id % 3 <> 0"), (2, "id % 2 = 0")):
        rows.where(part).withColumn("delivery", F.lit(n)).write.mode("append").option("header", True).csv(f"{out}/landing")
        pipeline.bronze(spark, f"{out}/landing", out, ["id", "delivery"])
        pipeline.silver(spark, out, "id", lambda d: d.withColumns({"k": convert.to_id(F.col("id")), "delivery": F.col("delivery").cast("int")}), {}, {}, repeats="30 days")
    held = pipeline.read(spark, out, "quarantine").where("_id_problem = 'repeated'").groupBy(F.col("id").cast("long").alias("k")).agg(F.count("*").alias("repeated"))
    return pipeline.read(spark, out, "silver").select("k", "delivery").join(held, "k", "left").na.fill(0, ["repeated"])


_AGREED = ["k", "status", "price"]
_DELIVERIES = {0: ["k", "status", "price"], 1: ["k", "clerk", "status", "price", "note"], 2: ["price", "k"], 3: ["price", "status", "k"]}


@query(f"""SELECT CAST({_K} AS VARCHAR) AS k, CASE WHEN {_K} % 4 <> 2 THEN o_orderstatus END AS status, CAST({_P} AS VARCHAR) AS price,
 CASE WHEN {_K} % 4 = 1 THEN '{{"clerk":"c' || CAST({_K} % 10 AS VARCHAR) || '"' || CASE WHEN {_K} % 5 = 0 THEN ',"note":"a \\"b\\", c"' ELSE '' END || '}}' END AS rescued FROM orders""")
def rescued_columns(spark, sf_dir):
    """Deliveries as agreed, with columns added, with one missing, and moved: each file read by its own header."""
    out = folder(spark)
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    rows = rows.withColumns({"clerk": F.concat(F.lit("c"), (F.col("k") % 10).cast("string")), "note": F.when(F.col("k") % 5 == 0, F.lit('a "b", c'))})
    for part, columns in _DELIVERIES.items():
        rows.where(F.col("k") % 4 == part).select(columns).write.mode("append").option("header", True).option("escape", '"').csv(f"{out}/landing")
        if part in (1, 3):
            rescue.bronze_rescued(spark, f"{out}/landing", out, _AGREED)
    return pipeline.read(spark, out, "bronze").select(*_AGREED, F.col("_rescued_data").alias("rescued"))


@query(" UNION ALL ".join(f"SELECT count(*) AS records, '{n}' AS check_name, count(*) FILTER (WHERE {bad}) AS failing_records, round(count(*) FILTER (WHERE {bad}) / count(*), 5) AS failing_share FROM {_GOOD}" for n, (_, bad) in RULES.items()))
def gold_quality_summary(spark, sf_dir):
    return _gold(spark, sf_dir, "quality_summary").drop("computed_at")


@query(f"""WITH r AS ({" UNION ALL ".join(f"SELECT '{n}' AS check_name, round(count(*) FILTER (WHERE {bad}) / count(*), 5) AS value, {0.05 if n.endswith('converted') else 0.01} AS t FROM {_GOOD}" for n, (_, bad) in RULES.items())})
 SELECT check_name, value, CASE WHEN value <= t THEN 'PASS' ELSE 'FAIL' END AS status FROM r UNION ALL SELECT 'conservation', 0, 'PASS' UNION ALL SELECT 'repeated ids', 0, 'PASS'
 UNION ALL SELECT 'quarantined rows reviewed', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM orders WHERE {_HELD}""")
def validate_run(spark, sf_dir):
    """The results that a run appends to its log before it fails."""
    out, run = _pipeline(spark, sf_dir), folder(spark)
    limits = {f"{v} converted": 0.05 for v in TEXTS.values()}
    try:
        pipeline.validate(spark, out, "id", limits, run_id=run, quarantine_id="id_text")
    except AssertionError:
        pass
    return tables.read_log(spark, f"{out}/results", pipeline.RESULTS).where(F.col("run_id") == run).select("check_name", "value", "status")
