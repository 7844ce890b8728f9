"""The registry and what its modules share: SQL fragments of the expected values, and the cleansed messy orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convert, dates, text
from ..sources.shared import folder
from .messy import messy_orders

QUERIES: dict = {}
ORACLE_SQL: dict = {}
AS_OF = "2026-01-01"
__all__ = ["AS_OF", "ORACLE_SQL", "QUERIES", "TEXTS", "folder", "query", "typed"]

_K = "(o_orderkey + 1)"
_ID = f"CASE WHEN {_K} % 97 = 0 OR {_K} % 89 = 0 THEN NULL ELSE {_K} END"
_DATE = f"CASE WHEN {_K} % 61 = 0 OR {_K} % 67 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END"
_P = "CAST(o_totalprice AS DECIMAL(12,2))"
_MONEY = f"CAST(CASE WHEN {_K} % 53 = 0 THEN NULL WHEN {_K} % 59 = 0 THEN 0 WHEN {_K} % 6 = 5 THEN -{_P} ELSE {_P} END AS DECIMAL(12,2))"
_POINTS = f"CASE WHEN {_K} % 47 = 0 THEN NULL ELSE {_K} % 11 END"
_TIME = f"CASE WHEN {_K} % 43 = 0 THEN NULL ELSE lpad(CAST({_K} % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST({_K} % 60 AS VARCHAR), 2, '0') || ':00' END"
_FLAG = f"CASE WHEN {_K} % 41 = 0 THEN NULL ELSE {_K} % 15 < 7 END"
_PRIORITY = f"CASE WHEN {_K} % 83 = 0 THEN NULL ELSE o_orderpriority END"


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TEXTS = {"date_text": "order_date", "money_text": "money", "points_text": "points", "time_text": "time", "flag_text": "flag"}


def typed(raw):
    """Stripped texts with typed columns, the raw text kept as ``as_written``; works on a stream, too."""
    rows = raw.withColumn("as_written", F.struct(*TEXTS)).withColumns({
        "id": convert.to_id(F.col("id_text")),
        "money": convert.to_money(F.col("money_text")),
        "points": convert.to_integer(F.col("points_text")),
        "time": convert.to_time(F.col("time_text")),
        "flag": convert.to_boolean(F.col("flag_text")),
    })
    return dates.resolve(rows, {"order_date": "date_text"}, {}, F.lit(AS_OF).cast("date"))


def _clean(spark, sf_dir):
    """Messy orders, stripped and typed."""
    return typed(text.strip_and_null(messy_orders(spark, sf_dir)))
