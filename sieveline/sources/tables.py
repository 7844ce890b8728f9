"""Files and tables as text tables arrive and leave: scans, hand-offs, logs, mapping tables and listings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import convert, text
from ..operators import quality


def read_text(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Delivered CSV, every column as text; an empty field is null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Delivered CSV with guessed types, for comparison with ``read_text``: the guess loses leading zeros.

    White space around a value is dropped before types are guessed: a number with a tab behind it would else count as a double.
    """
    return spark.read.option("header", True).option("inferSchema", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def read_key(spark: SparkSession, path: str, columns: Sequence[str], id_col: str) -> DataFrame:
    """Answer key: text, its ID converted so that it joins typed tables."""
    return read_text(spark, path, columns).withColumn(id_col, convert.to_id(text.strip(F.col(id_col))))


def hand_off(df: DataFrame, path: str, ids: Sequence[str]) -> None:
    """CSV whose IDs have eight digits again."""
    df.withColumns({c: text.pad_id(F.col(c)) for c in ids}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def null_total(df: DataFrame, stage: str) -> DataFrame:
    """(stage, nulls): nulls in all columns, in one scan."""
    total = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.lit(stage).alias("stage"), total.cast("bigint").alias("nulls"))


def round_trip_nulls(df: DataFrame, path: str) -> DataFrame:
    """(stage, nulls) as given, and after Parquet and CSV were written under ``path`` and read again."""
    spark = df.sparkSession
    df.write.parquet(f"{path}/parquet")
    df.write.option("header", True).option("escape", '"').csv(f"{path}/csv")
    typed, plain = spark.read.parquet(f"{path}/parquet"), read_text(spark, f"{path}/csv", df.columns)
    return null_total(df, "given").unionByName(null_total(typed, "parquet")).unionByName(null_total(plain, "csv"))


def save_table(df: DataFrame, name: str, rules: dict[str, str], comment: str = "", path: str | None = None, unique: Sequence[str] = ()) -> DataFrame:
    """Replace a managed table (external, with a path) by ``df`` once no row breaks a rule and no key repeats; returns the table."""
    writer = quality.gate(df, rules, unique).write.mode("overwrite").option("overwriteSchema", True)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    if comment:
        quoted = comment.replace("\\", "\\\\").replace("'", "\\'")
        df.sparkSession.sql(f"COMMENT ON TABLE {name} IS '{quoted}'")
    return df.sparkSession.table(name)


def id_rules(column: str) -> dict[str, str]:
    """What a stored ID satisfies besides being unique."""
    return {f"{column} present": f"`{column}` IS NOT NULL", f"{column} in range": f"`{column}` BETWEEN 1 AND 99999999"}


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to a log whose columns may grow."""
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log with all columns it ever had; no rows where it does not exist yet."""
    try:
        found = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    return found


def insert_absent(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Add the rows whose keys the log lacks, one of those that repeat a key among themselves; null keys are equal."""
    rows = rows.dropDuplicates(list(keys))
    log = read_log(rows.sparkSession, path, rows.schema.simpleString()[7:-1]).select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    append_log(rows.join(log, same, "left_anti"), path)


def save_reference(ref: DataFrame, key: str, path: str, name: str = "", comment: str = "") -> None:
    """Write a reference table once its keys are found unique; with a name, list it in the catalog with a comment."""
    quality.unique_keys(ref, key)
    if not name:
        return ref.write.mode("overwrite").parquet(path)
    save_table(ref, name, {f"{key} present": f"`{key}` IS NOT NULL"}, comment, path, [key])


def load_reference(spark: SparkSession, path: str) -> DataFrame:
    """A reference table, all text."""
    ref = spark.read.parquet(path)
    return ref.select(*[F.col(c).cast("string") for c in ref.columns])


def rows_per_file(df: DataFrame, file_col: str = "_source_file") -> DataFrame:
    return df.groupBy(file_col).agg(F.count("*").alias("n"))


def replace_rows(table: DataFrame, gone: Column, rows: DataFrame) -> DataFrame:
    """``table`` without the rows where ``gone`` is true, with ``rows`` instead; write it to another path."""
    return table.where(~F.coalesce(gone, F.lit(False))).unionByName(rows)


def row_range(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows start to stop - 1, from 0, in the order of the key; only ``stop`` rows leave each task."""
    return df.orderBy(key).offset(start).limit(stop - start)


def save_lookup(df: DataFrame, name: str, id_col: str, path: str, buckets: int = 64) -> DataFrame:
    """Replace a table made for point lookups: bucketed and sorted by the ID, one file a bucket, with Bloom filters of the ID.

    ``find_id`` on it reads the one file of the ID's bucket, and of that only the row groups that may hold the ID.
    """
    dealt = df.repartition(buckets, F.col(id_col)).sortWithinPartitions(id_col)
    writer = dealt.write.mode("overwrite").bucketBy(buckets, id_col).sortBy(id_col).option("path", path)
    writer.option(f"parquet.bloom.filter.enabled#{id_col}", "true").saveAsTable(name)
    return df.sparkSession.table(name)


def find_id(df: DataFrame, id_col: str, written: str) -> DataFrame:
    """Rows of an ID as people write it; a text that is no ID is an error, not an empty answer."""
    digits = written.strip()
    if not (digits.isascii() and digits.isdigit() and len(digits) == 8):
        raise ValueError(f"not an ID of 8 digits: {written!r}")
    return df.where(F.col(id_col) == int(digits))


def types_of(df: DataFrame, name: str) -> DataFrame:
    """(column_name, name): each column's type."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], f"column_name string, {name} string")


def compare_types(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column_name, type_before, type_after, changed), also of columns that only one side has."""
    both = types_of(before, "type_before").join(types_of(after, "type_after"), "column_name", "full_outer")
    return both.withColumn("changed", ~F.col("type_before").eqNullSafe(F.col("type_after")))


def list_tables(spark: SparkSession) -> DataFrame:
    """(table_name, column_name, data_type, comment) of the current database."""
    rows = [(t.name, c.name, c.dataType, t.description) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, comment string")
