"""Crosswalks, exception lists, reports and gates over cleansed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

#: A crosswalk is reference data; one of more rows than this is joined without a broadcast hint.
BROADCAST_ROWS = 100_000


def unique_keys(ref: DataFrame, key: str) -> DataFrame:
    """``ref``, after checking that its key is unique, so that a join keeps the row count."""
    rows, keys, missing = ref.agg(F.count("*"), F.count_distinct(key), F.count_if(F.col(key).isNull())).first()
    if missing or rows != keys:
        raise ValueError(f"crosswalk key {key}: {rows} rows, {keys} distinct, {missing} missing")
    return F.broadcast(ref) if rows <= BROADCAST_ROWS else ref


def crosswalk(df: DataFrame, ref: DataFrame, key: Column, ref_key: str, values: dict[str, str]) -> DataFrame:
    """Left lookup of ``key``; ``values`` maps columns of ``ref`` to new names. Unmapped keys give null."""
    side = unique_keys(ref.select(F.col(ref_key).alias("_ref"), *[F.col(k).alias(v) for k, v in values.items()]), "_ref")
    return df.withColumn("_key", key).join(side, F.col("_key") == F.col("_ref"), "left").drop("_key", "_ref")


def exceptions(df: DataFrame, id_col: str, parts: Sequence[tuple[str, Column, Column, str]]) -> DataFrame:
    """(id, column, value_as_written, reason), from (column, raw text, is an exception, reason), in one scan."""
    found = F.array(*[F.struct(F.lit(n).alias("column"), raw.alias("value_as_written"), F.coalesce(bad, F.lit(False)).alias("bad"), F.lit(why).alias("reason")) for n, raw, bad, why in parts])
    out = df.select(id_col, F.explode(F.filter(found, lambda x: x["bad"])).alias("x"))
    return out.select(id_col, "x.column", "x.value_as_written", "x.reason")


def long_form(one_row: DataFrame, name: str = "check_name", value: str = "n") -> DataFrame:
    """One wide row as (name, value) rows."""
    parts = ", ".join(f"'{c}', `{c}`" for c in one_row.columns)
    return one_row.selectExpr(f"stack({len(one_row.columns)}, {parts}) AS ({name}, {value})")


def counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check_name, n): rows that satisfy each condition, in one scan."""
    return long_form(df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()]))


def summary(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(records, check_name, failing_records, failing_share) of named SQL rules, in one scan. A rule that is null holds."""
    wide = df.agg(F.count("*").alias("_records"), *[F.count_if(~F.expr(r)).alias(n) for n, r in rules.items()])
    parts = ", ".join(f"'{n}', `{n}`" for n in rules)
    long = wide.selectExpr("_records AS records", f"stack({len(rules)}, {parts}) AS (check_name, failing_records)")
    return long.withColumn("failing_share", F.round(F.coalesce(F.try_divide("failing_records", "records"), F.lit(0.0)), 5))


def gate(df: DataFrame, rules: dict[str, str], unique: Sequence[str] = ()) -> DataFrame:
    """``df`` if no row breaks a named SQL rule and no value of a ``unique`` column repeats, in one scan; raises otherwise.

    A rule that is null holds; nulls do not repeat.
    """
    repeats = [(F.count(c) - F.count_distinct(c)).alias(f"{c} repeated") for c in unique]
    row = df.agg(*[F.count_if(~F.expr(r)).alias(n) for n, r in rules.items()], *repeats).first()
    if broken := {n: k for n, k in row.asDict().items() if k}:
        raise ValueError(f"rules broken: {broken}")
    return df


def strict_ids(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with the ID text as a whole number; raises if one is missing, is no ID or repeats."""
    gate(df, {"ID missing": f"`{id_col}` IS NOT NULL", "not 8 digits": f"`{id_col}` RLIKE '^[0-9]{{8}}$'"}, [id_col])
    return df.withColumn(id_col, F.col(id_col).cast("bigint"))


def id_check(df: DataFrame, id_col: str) -> DataFrame:
    """(check_name, n): what shows that a stored ID is one: rows, distinct, missing, out of range, and 1 if its type is bigint."""
    c = F.col(id_col)
    return long_form(df.agg(F.count("*").alias("records"), F.count_distinct(c).alias("distinct ids"), F.count_if(c.isNull()).alias("missing"), F.count_if((c < 1) | (c > 99_999_999)).alias("out of range"), F.lit(int(dict(df.dtypes)[id_col] == "bigint")).cast("bigint").alias("is bigint")))


def key_checks(df: DataFrame, id_text: str, person_text: str, name: str) -> DataFrame:
    """(check_name, n): seven counts to see before trusting a join: of the ID texts, of the persons' and of their records."""
    i, p = F.col(id_text), F.col(person_text)
    bad = lambda c: F.count_if(~c.rlike("^[0-9]{8}$"))
    one = df.agg(F.count_if(i.isNull()).alias("id missing"), (F.count(i) - F.count_distinct(i)).alias("id repeated"), bad(i).alias("id invalid"), F.count_if(p.isNull()).alias("person missing"), bad(p).alias("person invalid"))
    people = df.where(p.isNotNull()).groupBy(p.alias("p")).agg(F.count_distinct(name).alias("names"), F.count("*").alias("records"))
    two = people.agg(F.count_if(F.col("names") > 1).alias("people with conflicting names"), F.count_if(F.col("records") > 1).alias("people with several records"))
    return long_form(one).unionByName(long_form(two))


def changed(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(check_name, n): values that a step changed, from name -> (before, after), in one scan."""
    return counts(df, {n: ~before.eqNullSafe(after) for n, (before, after) in pairs.items()})


def conversion_report(df: DataFrame, columns: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(column_name, missing, failed, converted) from name -> (text as written, typed value), in one scan."""
    cells = [F.struct(F.lit(n).alias("column_name"), F.count_if(raw.isNull()).alias("missing"), F.count_if(raw.isNotNull() & value.isNull()).alias("failed"), F.count_if(raw.isNotNull() & value.isNotNull()).alias("converted")) for n, (raw, value) in columns.items()]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def member(df: DataFrame, code: Column, ref: DataFrame, ref_key: str, out: str) -> DataFrame:
    """``df`` with ``out``: the code where the reference table has it, else null."""
    side = unique_keys(ref.select(F.col(ref_key).alias("_ref")), "_ref")
    return df.withColumn("_key", code).join(side, F.col("_key") == F.col("_ref"), "left").withColumn(out, F.col("_ref")).drop("_key", "_ref")


def apply_domains(df: DataFrame, domains: Sequence[tuple[Column, DataFrame, str, dict[str, str]]]) -> DataFrame:
    """All crosswalks in turn, each as (key, table, its key, {its column: new name}); also on a stream."""
    for key, ref, ref_key, values in domains:
        df = crosswalk(df, ref, key, ref_key, values)
    return df


def rows_of(df: DataFrame, found: DataFrame, person: str) -> DataFrame:
    """All rows of the people in ``found``."""
    return df.join(found.select(person).distinct(), person, "left_semi")


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """(metric, left_side, right_side, agrees) of two one-row tables of metrics, also of those that only one side has."""
    a, b = (long_form(x.select(*[F.col(f"`{c}`").cast("decimal(38,3)").alias(c) for c in x.columns]), "metric", n) for x, n in ((left, "left_side"), (right, "right_side")))
    return a.join(b, "metric", "full_outer").withColumn("agrees", F.col("left_side").eqNullSafe(F.col("right_side")))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n, mean, deviation, least, greatest) of numeric columns, in one scan."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.round(F.avg(F.col(c).cast("double")), 3).alias("mean"), F.round(F.stddev_samp(F.col(c).cast("double")), 3).alias("deviation"), F.min(F.col(c).cast("double")).alias("least"), F.max(F.col(c).cast("double")).alias("greatest")) for c in columns]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def conflicts(df: DataFrame, person: str, code: str, ignore: Sequence[str] = ()) -> DataFrame:
    """(person, codes): people with several distinct codes, sorted and joined by '/'."""
    known = df.where(F.col(person).isNotNull() & F.col(code).isNotNull() & ~F.col(code).isin(*ignore)).select(person, code).distinct()
    found = known.groupBy(person).agg(F.array_sort(F.collect_list(code)).alias("codes")).where(F.size("codes") > 1)
    return found.select(person, F.array_join("codes", "/").alias("codes"))


def profile(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """(column_name, rows, nulls, null_share, distinct_values, least, greatest, median) of each column, in one aggregate.

    Distinct values and medians are approximate unless ``exact`` asks for the cost of exact ones; median is of numbers only.
    """
    distinct, middle = (F.count_distinct, lambda c: F.percentile(c, F.lit(0.5))) if exact else (F.approx_count_distinct, lambda c: F.percentile_approx(c, F.lit(0.5)).cast("double"))
    numbers = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}

    def cell(c: str) -> Column:
        n, nulls = F.count(F.lit(1)), F.count_if(F.col(c).isNull())
        parts = {"column_name": F.lit(c), "rows": n, "nulls": nulls, "null_share": F.round(F.coalesce(F.try_divide(nulls, n), F.lit(0.0)), 5), "distinct_values": distinct(c), "least": F.min(c).cast("string"), "greatest": F.max(c).cast("string"), "median": middle(c) if c in numbers else F.lit(None).cast("double")}
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    return df.agg(F.array(*map(cell, columns)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def first_per_value(df: DataFrame, value: str, key: str, n: int = 1) -> DataFrame:
    """The first n rows of each value in the order of the key."""
    w = Window.partitionBy(value).orderBy(key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def score(df: DataFrame, predictors: dict[str, Column], truth: Column) -> DataFrame:
    """Confusion counts, precision, recall and F1 of each predictor, in one scan."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(p, F.lit(False)).alias("p")) for n, p in predictors.items()])
    x = df.select(truth.alias("t"), F.explode(cells).alias("x")).select("t", "x.*")
    x = x.groupBy("name").agg(F.count_if(F.col("p")).alias("returned"), F.count_if(F.col("p") & F.col("t")).alias("correct"), F.count_if(F.col("p") & ~F.col("t")).alias("wrong"), F.count_if(~F.col("p") & F.col("t")).alias("missed"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    x = x.withColumn("precision", ratio(F.col("correct"), F.col("returned"))).withColumn("recall", ratio(F.col("correct"), F.col("correct") + F.col("missed")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return x.select("name", "returned", "correct", "wrong", "missed", F.round("precision", 3).alias("precision"), F.round("recall", 3).alias("recall"), F.round(f1, 3).alias("f1"))


def suspects(df: DataFrame, columns: Sequence[str], tokens: Sequence[str]) -> DataFrame:
    """(column_name, token, n): how often each unknown-looking code stands in each text column, in one scan."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("token")) for c in columns])
    x = df.select(F.explode(F.filter(cells, lambda x: x["token"].isin(*tokens))).alias("x")).select("x.*")
    return x.groupBy("column_name", "token").agg(F.count("*").alias("n"))


def whitespace(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, header_padded, padded, blank): white space around a header, at an end of texts, and texts of nothing else."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in columns])
    x = df.select(F.explode(cells).alias("x")).select("x.*")
    name, bare = F.col("column_name"), text.strip(F.col("column_name"))
    return x.groupBy(bare.alias("column_name"), (name != bare).alias("header_padded")).agg(F.count_if(F.col("v").rlike(r"(?U)^\s|\s$")).alias("padded"), F.count_if(F.col("v").rlike(r"(?U)^\s+$")).alias("blank"))


def expectation_metrics(log: DataFrame, details: str) -> DataFrame:
    """(dataset, rule, passed, failed) from a log of JSON arrays of {dataset, name, passed, failed}; broken JSON counts nowhere."""
    x = log.select(F.explode(F.from_json(details, "array<struct<dataset: string, name: string, passed: bigint, failed: bigint>>")).alias("x")).select("x.*")
    return x.groupBy("dataset", F.col("name").alias("rule")).agg(F.sum("passed").alias("passed"), F.sum("failed").alias("failed"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each measure between two results of ``profile``."""
    b = before.select("column_name", *[F.col(c).alias(f"_{c}") for c in ("rows", "distinct_values", "nulls")])
    change = lambda c: (F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"_{c}"), F.lit(0)))
    return after.join(b, "column_name", "full_outer").select("column_name", change("rows").alias("rows_change"), change("distinct_values").alias("distinct_change"), change("nulls").alias("nulls_change"))


def scorecard(df: DataFrame, questions: Sequence[str], naive: Sequence[Column], typed: Sequence[Column]) -> DataFrame:
    """(question, naive, typed, changed): the same questions to the texts as they came and to the typed columns, in one scan."""
    whole = [F.coalesce(c.cast("bigint"), F.lit(0)).alias(f"{side}{k}") for side, cs in (("n", naive), ("t", typed)) for k, c in enumerate(cs)]
    cells = F.array(*[F.struct(F.lit(q).alias("question"), F.col(f"n{k}").alias("naive"), F.col(f"t{k}").alias("typed")) for k, q in enumerate(questions)])
    x = df.agg(*whole).select(F.explode(cells).alias("x")).select("x.*")
    return x.withColumn("changed", F.col("naive") != F.col("typed"))
