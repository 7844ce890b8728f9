"""Deterministic messy views over the clean tables: the mess follows from the key, so the truth stays known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_READY: dict[tuple[str, str], str] = {}


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Write the messy orders once, so that this session's queries over ``sf_dir`` read them and do not make them: for timing."""
    path = folder(spark)
    messy_orders(spark, sf_dir).write.parquet(path)
    _READY[spark.sparkContext.applicationId, sf_dir] = path


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy orders, made from the tables or read as ``prepare`` wrote them."""
    if path := _READY.get((spark.sparkContext.applicationId, sf_dir)):
        return spark.read.parquet(path)
    return _made_orders(spark, sf_dir)


def _made_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose ID, date, money, points, time, flag, priority and note are text as people write it; k = o_orderkey + 1."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey + 1 AS k", "o_custkey", "o_orderstatus", "o_orderpriority", "CAST(o_orderdate AS DATE) AS d", "CAST(o_totalprice AS DECIMAL(12,2)) AS p")
    return o.selectExpr(
        "k", "o_custkey", "o_orderstatus", "o_orderpriority",
        "CASE WHEN k % 97 = 0 THEN lpad(CAST(k AS STRING), 7, '0') WHEN k % 89 = 0 THEN '  ' ELSE concat(' ', lpad(CAST(k AS STRING), 8, '0'), '\t') END AS id_text",
        "CASE WHEN (k + o_custkey) % 71 = 0 THEN ' ' WHEN k % 73 = 0 THEN lpad(CAST(o_custkey + 1 AS STRING), 7, '0') ELSE lpad(CAST(o_custkey + 1 AS STRING), 8, '0') END AS person_text",
        """CASE WHEN k % 61 = 0 THEN '02/30/2020' WHEN k % 67 = 0 THEN '   ' ELSE CASE k % 9 WHEN 0 THEN date_format(d, 'MM/dd/yyyy')
           WHEN 1 THEN date_format(d, 'M/d/yy') WHEN 2 THEN date_format(d, 'MM-dd-yyyy') WHEN 3 THEN date_format(d, 'yyyy-MM-dd')
           WHEN 4 THEN date_format(d, 'yyyy-MM-dd HH:mm:ss') WHEN 5 THEN date_format(d, 'yyyyMMdd') WHEN 6 THEN date_format(d, 'dd-MMM-yyyy')
           WHEN 7 THEN date_format(d, 'MMMM d, yyyy') ELSE date_format(d, 'MMM d yyyy') END END AS date_text""",
        """CASE WHEN k % 53 = 0 THEN 'TBD' WHEN k % 59 = 0 THEN '-' ELSE CASE k % 6 WHEN 0 THEN concat('$', format_number(p, 2)) WHEN 1 THEN CAST(p AS STRING)
           WHEN 2 THEN format_number(p, 2) WHEN 3 THEN concat('$ ', format_number(p, 2)) WHEN 4 THEN concat('USD ', format_number(p, 2))
           ELSE concat('(', format_number(p, 2), ')') END END AS money_text""",
        """CASE WHEN k % 47 = 0 THEN '2.5' ELSE CASE k % 5 WHEN 0 THEN CAST(k % 11 AS STRING) WHEN 1 THEN lpad(CAST(k % 11 AS STRING), 2, '0')
           WHEN 2 THEN concat(CAST(k % 11 AS STRING), '.0') WHEN 3 THEN concat(CAST(k % 11 AS STRING), ' pts')
           ELSE element_at(array('zero','one','two','three','four','five','six','seven','eight','nine','ten'), CAST(k % 11 AS INT) + 1) END END AS points_text""",
        """CASE WHEN k % 43 = 0 THEN '25:10' ELSE date_format(make_timestamp(2000, 1, 1, CAST(k % 24 AS INT), CAST(k % 60 AS INT), 0),
           element_at(array('HH:mm', 'HH:mm:ss', 'h:mm a', 'hh:mm a', 'h:mma', 'HHmm', 'HH.mm'), CAST(k % 7 AS INT) + 1)) END AS time_text""",
        "CASE WHEN k % 41 = 0 THEN '?' ELSE element_at(array('Y','Yes','YES','1','TRUE','T','X','N','No','NO','0','FALSE','F','f','n'), CAST(k % 15 AS INT) + 1) END AS flag_text",
        """CASE WHEN k % 83 = 0 THEN 'XX' ELSE CASE k % 4 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN concat(' ', replace(o_orderpriority, '-', ' - '))
           WHEN 2 THEN concat(o_orderpriority, '.') ELSE o_orderpriority END END AS priority_text""",
        """CASE WHEN k % 79 = 0 THEN 'A/B' ELSE element_at(array('SUSP: ALPHA','ALPHA (C)','EX-ALPHA','ALPHA','CONFIRMED ALPHA','ALPHA-SUSPECTED','ALPHA (S)','ALPHA-RENOUNCED','FORMER ALPHA','ALPHA (FORMER)','ALPHA-CONFIRMED','NONE'),
           CAST(k % 12 AS INT) + 1) END AS group_text""",
        """element_at(array('He was helpful today','No good conduct seen','She was not very helpful at all','Good Friday service','GOOD work','goods delivered late','A better day','refused to work',
           'never helpful','cooperative and polite'), CAST(k % 10 AS INT) + 1) AS note""",
        """CASE k % 8 WHEN 0 THEN 'it<br>works' WHEN 1 THEN 'it&nbsp;works' WHEN 2 THEN '“it works”' WHEN 3 THEN 'it isnâ€™t' WHEN 4 THEN 'it  works' WHEN 5 THEN 'MUÃ‘OZ – x<br />y'
           WHEN 6 THEN 'JosÃ© &amp; â€œMÃ¡â€' ELSE '<br>' END AS damaged_note""",
        """element_at(array('He was very helpful and polite','Not a good day','She isn\\'t good with tools','anything but respectful','Lost good time credits','never had good conduct time, polite man','good times here','goods delivered late',
           'no issues on the wing','never had no issues before','a better worker','refused twice','not once in all these weeks was he good'), CAST(k % 13 AS INT) + 1) AS conduct""",
    )


def messy_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and six coded values as people spell them: in small letters, with a period, with spaces around a hyphen; 'XX' is in no table."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey + 1 AS k", "o_custkey", "o_orderstatus AS status", "o_orderpriority AS priority", "CASE WHEN o_orderkey % 2 = 0 THEN 'ALPHA' ELSE 'BETA-ONE' END AS `group`")
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey", "c_mktsegment AS segment")
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_regionkey", "n_name AS nation").join(table(spark, sf_dir, "region").selectExpr("r_regionkey", "r_name AS region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = o.join(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    said = lambda c, m: f"CASE WHEN k % {m} = 0 THEN 'XX' ELSE CASE k % 4 WHEN 0 THEN lower(`{c}`) WHEN 1 THEN concat(' ', replace(`{c}`, '-', ' - ')) WHEN 2 THEN concat(`{c}`, '.') ELSE `{c}` END END AS {c}_text"
    return rows.selectExpr("k", *[said(c, m) for c, m in CODED.items()])


#: Each coded value and the divisor of the keys whose spelling is in no table.
CODED = {"priority": 83, "segment": 59, "nation": 53, "region": 47, "status": 43, "group": 41}
