"""What readers may see: masks, row filters, published views and practice subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mask(c: Column, allowed: Column, shown: str = "RESTRICTED") -> Column:
    """The value where the reader is allowed to see it, else ``shown``; a null ``allowed`` hides."""
    return F.when(allowed, c).otherwise(F.lit(shown))


def row_filter(df: DataFrame, access: DataFrame, unit: str, reader: str, access_unit: str = "unit", access_reader: str = "reader") -> DataFrame:
    """Rows of the units that the access table gives to the reader; a unit listed twice gives each row once."""
    own = access.where(F.col(access_reader) == reader).select(F.col(access_unit).alias("_unit"))
    return df.join(own, F.col(unit) == F.col("_unit"), "left_semi")


def published(df: DataFrame, columns: dict[str, str], masked: Sequence[str] = (), allowed: Column | None = None) -> DataFrame:
    """The agreed columns, renamed (name in ``df`` -> shown name), the masked ones hidden from readers not allowed."""
    hidden = F.lit(False) if allowed is None else allowed
    return df.select(*[(mask(F.col(c), hidden) if c in masked else F.col(c)).alias(shown) for c, shown in columns.items()])


def practice(df: DataFrame, unit: str, units: Sequence, key: str, n: int = 200) -> DataFrame:
    """The first n rows, by key, of a few units, to practise on."""
    return df.where(F.col(unit).isin(*units)).orderBy(key).limit(n)


def sql_string(value: str) -> str:
    """A text as a literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_mask(spark: SparkSession, name: str, groups: Sequence[str], shown: str = "RESTRICTED") -> None:
    """A SQL function of the session: ``name(value, reader_groups)`` is the value for readers in one of ``groups``, else ``shown``.

    Spark has no directory of groups, so whoever opens the session for a reader passes the reader's.
    """
    listed = ", ".join(map(sql_string, groups)) or "CAST(NULL AS STRING)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING, reader_groups ARRAY<STRING>) RETURNS STRING RETURN CASE WHEN coalesce(arrays_overlap(array({listed}), reader_groups), FALSE) THEN value ELSE {sql_string(shown)} END")


def create_unit_filter(spark: SparkSession, name: str, access: str, unit: str = "unit", reader: str = "reader") -> None:
    """A SQL function of the session: ``name(reader)`` is a table of the units that the table or view ``access`` gives to the reader.

    ``WHERE unit_code IN (SELECT unit FROM name('me'))`` then keeps a reader's rows by a semi join, which no row-by-row
    lookup matches; access stays data: a changed row of ``access`` counts from the next query on.
    """
    kind = spark.table(access).schema[unit].dataType.simpleString()
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(asked STRING) RETURNS TABLE (unit {kind}) RETURN SELECT DISTINCT a.`{unit}` FROM {access} a WHERE a.`{reader}` = {name}.asked")
