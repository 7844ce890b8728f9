"""Column profiles as stored sketches: one scan a snapshot, and snapshots of any number merge without reading the data again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sizes of the sketches: 2^LG_K registers (standard error of a distinct count 1.04 / sqrt(2^LG_K), 0.8 %), and K of the
#: quantile sketch (a rank is within 0.7 % with 99 % confidence).
LG_K, K = 14, 400
#: Shares whose quantiles are compared between snapshots, which is how fine a shift is told.
PROBES = tuple((k + 0.5) / 100 for k in range(100))


def sketch(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, rows, nulls, distinct_sketch, value_sketch) of each column, in one aggregate; values of numbers only.

    Distinct values of types that the sketch does not take are counted by their text.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    taken = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)

    def cell(c: str) -> Column:
        v = F.col(f"`{c}`")
        known = F.hll_sketch_agg(v if isinstance(kinds[c], taken) else v.cast("string"), F.lit(LG_K))
        values = F.kll_sketch_agg_double(v.cast("double"), F.lit(K)) if isinstance(kinds[c], T.NumericType) else F.lit(None).cast("binary")
        parts = {"column_name": F.lit(c), "rows": F.count(F.lit(1)), "nulls": F.count_if(v.isNull()), "distinct_sketch": known, "value_sketch": values}
        return F.struct(*[x.alias(k) for k, x in parts.items()])

    return df.agg(F.array(*map(cell, columns)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def merge(sketches: DataFrame) -> DataFrame:
    """The sketches of all snapshots of a column as one."""
    by = sketches.groupBy("column_name").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch", F.lit(K)).alias("value_sketch"), F.count("value_sketch").alias("_n"))
    return by.withColumn("value_sketch", F.when(F.col("_n") > 0, F.col("value_sketch"))).drop("_n")


def _filled(c: str = "value_sketch") -> Column:
    """Whether a quantile sketch has values: one of none has no quantiles to ask for."""
    return F.coalesce(F.kll_sketch_get_n_double(c), F.lit(0)) > 0


def estimates(sketches: DataFrame) -> DataFrame:
    """(column_name, rows, nulls, distinct_values, median) that the sketches tell."""
    median = F.when(_filled(), F.kll_sketch_get_quantile_double("value_sketch", F.lit(0.5)))
    return sketches.select("column_name", "rows", "nulls", F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"), median.alias("median"))


def sketch_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column_name, rows_change, nulls_change, distinct_change, shift) between two sets of sketches of the same columns.

    ``shift`` is the largest difference between the shares of values up to some value on both sides, told in steps of one
    in a hundred by the quantiles of the sketches; null where a side has no numbers. A column of one side only counts as
    empty on the other.
    """
    b = before.select("column_name", *[F.col(c).alias(f"_{c}") for c in before.columns if c != "column_name"])
    both = after.join(b, "column_name", "full_outer")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"_{c}"), F.lit(0))
    distinct = lambda c: F.coalesce(F.hll_sketch_estimate(c), F.lit(0))
    comparable = _filled() & _filled("_value_sketch")
    points = lambda c: F.kll_sketch_get_quantile_double(c, F.array(*[F.lit(p) for p in PROBES]))
    upto = lambda side, q: F.size(F.filter(side, lambda x: x <= q)) / float(len(PROBES))
    both = both.withColumns({"now": F.when(comparable, points("value_sketch")), "then": F.when(comparable, points("_value_sketch"))})
    moved = F.array_max(F.transform(F.concat("now", "then"), lambda q: F.abs(upto(F.col("now"), q) - upto(F.col("then"), q))))
    return both.select("column_name", count("rows").alias("rows_change"), count("nulls").alias("nulls_change"), (distinct("distinct_sketch") - distinct("_distinct_sketch")).alias("distinct_change"), moved.alias("shift"))
