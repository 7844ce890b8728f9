"""Literal spellings of each conversion."""

import pytest
from pyspark.sql import functions as F

from sieveline.functions import convert, dates, text
from sieveline.operators import quality


def one(spark, column, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("v")).cast("string")).collect()]


def test_money(spark):
    got = one(spark, convert.to_money, ["$1,234.50", "USD 1,234.50", "(12.00)", "-", "TBD", "$1,2O0.00", "1(2)3", "(-)", "1.005", "99999999999999", None])
    assert got == ["1234.50", "1234.50", "-12.00", "0.00", None, None, None, None, "1.01", None, None]


def test_integer(spark):
    assert one(spark, convert.to_integer, ["3", "03", "3.0", "3 pts", "three", "2.5", "1d", "nan", "1e3", None]) == ["3", "3", "3", "3", "3", None, None, None, None, None]


def test_time(spark):
    got = one(spark, convert.to_time, ["07:42", "07:42:00", "7:42 AM", "07:42 pm", "7:42AM", "0742", "07.42", "25:10", "12:75", "noon"])
    assert got == ["07:42:00", "07:42:00", "07:42:00", "19:42:00", "07:42:00", "07:42:00", "07:42:00", None, None, None]


def test_dates(spark):
    values = ["06/18/1978", "2/19/64", "11-23-1983", "1213-03-22", "1979-02-20 00:00:00", "19851029", "14-MAR-2017", "March 14, 1989", "Dec 18 1975", "02/30/2020"]
    as_of = F.lit("2026-01-01").cast("date")
    got = one(spark, lambda c: dates.century_past(c, dates.parse_date(c), as_of), values)
    assert got == ["1978-06-18", "1964-02-19", "1983-11-23", "1213-03-22", "1979-02-20", "1985-10-29", "2017-03-14", "1989-03-14", "1975-12-18", None]


def test_text(spark):
    assert one(spark, text.strip, ["  a\t", "  ", "", None]) == ["a", None, None, None]
    names = ["MCDONALD", "o'neil", "smith-jones", "DE LA CRUZ", "maria de la cruz JR.", "macdonald iii", "mc", "d'angelo-mcbride", None]
    assert one(spark, text.display_name, names) == ["McDonald", "O'Neil", "Smith-Jones", "De la Cruz", "Maria de la Cruz Jr", "MacDonald III", "Mc", "D'Angelo-McBride", None]
    assert one(spark, text.repair_text, ["MUÃ‘OZ – x<br />y", "â€œJosÃ©â€\u009d", "a\u00a0 b", "<br>", None]) == ["MUÑOZ - x y", '"José"', "a b", None, None]
    assert one(spark, text.fold_accents, ["Čapek Łódź Ørsted ñandú ß"]) == ["Capek Łodz Ørsted nandu ß"]
    status = lambda k: text.group_status(text.domain_key(k))
    written = ["SUSP: H.Y.D.R.A.", "INTERGANG (C)", "EX-LOA", "LOA-RENOUNCED", "LOA (FORMER)", "susp loa", "LOA (S)", "Confirmed Loa", "LOA", "EXETER", None]
    assert one(spark, lambda c: status(c)[1], written) == ["Suspected", "Confirmed", "Former", "Former", "Former", "Suspected", "Suspected", "Confirmed", None, None, None]
    assert one(spark, lambda c: status(c)[0], written) == ["HYDRA", "INTERGANG", "LOA", "LOA", "LOA", "LOA", "LOA", "LOA", "LOA", "EXETER", None]
    assert one(spark, text.domain_key, ["R.C.", " h / b "]) == ["RC", "H/B"]
    assert one(spark, text.offense_key, ["13-a", "9B", "290.0"]) == ["13A", "09B", "290"]


def test_centuries_ages_and_flags(spark):
    rows = [("2/29/00", "2000-02-29", "1999-12-31"), ("1/1/26", "2026-01-01", None), ("1/2/26", "2026-01-02", "1926-01-02"), ("3/4/68", "2068-03-04", None), ("3/4/69", "2069-03-04", None), ("03/04/2069", "2069-03-04", "1990-01-01"), ("5/6/30", "2030-05-06", "2031-01-01"), (None, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, raw string, d string, ref string").withColumns({c: F.col(c).cast("date") for c in ("d", "ref")})
    as_of = F.lit("2026-01-01").cast("date")
    got = df.orderBy("k").select(dates.century_past(F.col("raw"), F.col("d"), as_of).cast("string"), dates.century_after(F.col("raw"), F.col("d"), F.col("ref")).cast("string")).collect()
    assert [r[0] for r in got] == ["2000-02-29", "2026-01-01", "1926-01-02", "1968-03-04", "1969-03-04", "2069-03-04", "1930-05-06", None]
    assert [r[1] for r in got] == ["2000-02-29", "2026-01-01", "1926-01-02", "2068-03-04", "1969-03-04", "2069-03-04", "2030-05-06", None]
    ages = [("2000-02-29", "2001-02-28", 0), ("2000-02-29", "2001-03-01", 1), ("2000-05-05", "2018-05-05", 18), ("2000-05-05", "2018-05-04", 17), ("2000-01-02", "2000-01-01", -1), (None, "2000-01-01", None)]
    df = spark.createDataFrame(ages, "a string, b string, n int").select(dates.age_years(F.col("a").cast("date"), F.col("b").cast("date")).alias("got"), "n")
    assert all(r["got"] == r["n"] for r in df.collect())
    born = ["1899-12-31", "2026-01-02", "2015-01-01", "1920-01-01", "1980-01-01"]
    flag = lambda c: dates.birth_flag(c.cast("date"), dates.age_years(c.cast("date"), as_of), as_of)
    assert one(spark, flag, born) == ["before 1900", "in the future", "under 17", "over 100", None]


def test_dates_are_parsed_once(spark):
    df = spark.createDataFrame([("1/2/03", "2/3/04")], "a string, b string")
    plan = dates.resolve(df, {"x": "a"}, {"y": ("b", "x")}, F.lit("2026-01-01").cast("date"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp(") + plan.count("try_to_timestamp(") <= 2 * len(dates.FORMATS)


def test_gate_and_crosswalk(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    assert quality.gate(df, {"positive": "a > 0"}).count() == 2
    with pytest.raises(ValueError):
        quality.gate(df, {"one": "a = 1"})
    with pytest.raises(ValueError):
        quality.unique_keys(spark.createDataFrame([("x",), ("x",)], "k string"), "k")
