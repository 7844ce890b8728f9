"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the key -ln(u) / w (u: uniform by a hash of its id and text, w: its quality weight), and a
source is taken in ascending key order. A target of e whole epochs and a rest takes every document e times and
then, in key order, documents until the rest is reached. The order is never produced as a sort: sums over ranges of
keys give, for each source, the range in which the rest ends; that range is divided again until few keys are left.
What comes out is one key for each source, up to which documents are taken, so every row is decided by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, free_names, small

WEIGHTS = (5.0, 2.0, 1.0)
#: Ranges into which a range of keys is divided, and the rows of a range that is looked at key by key.
RANGES, FEW = 1024, 1000


def quality_weight(text: Column) -> Column:
    """Share of letters among a text's characters, from 0.1 to 1: prose counts more than debris."""
    letters = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]", ""))
    return F.greatest(F.lit(0.1), F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.1)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes. No target
    exceeds ``ceiling`` times its source's size: filling sources in the order of size by weight, all up to the
    first that stays below its ceiling are full, and the others share the rest by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("full", F.col("source_size") * F.lit(float(ceiling)))
    fill = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("before", F.coalesce(F.sum("full").over(before), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.col("before")) / F.col("w_left"))
    # the first source (in this order) that its ceiling does not stop fixes the level of itself and all after it
    s = s.withColumn("open", F.when(F.col("level") * F.col("w") < F.col("full"), F.col("level")))
    level = F.first("open", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0))
    return s.select("source", "source_size", F.coalesce(F.least(level * F.col("w"), F.col("full")), F.col("full")).alias("target"))


def size_of(text: Column) -> Column:
    """Words of a text; none of a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(id_col: Column, text: Column, seed: int, weight: Callable[[Column], Column]) -> Column:
    unit = (F.xxhash64(id_col, text, F.lit(seed)).cast("double") / 2.0**64) + 0.5
    return -F.log(F.greatest(unit, F.lit(1e-18))) / weight(text)


def sampling_plan(keyed: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size, target, epochs, stop, stop_in) of each source of ``keyed`` (source, size, key).

    A document is taken ``epochs`` times, and once more if its key lies before ``stop``, or is ``stop`` and ``stop_in``.
    """
    sizes = scratch.write(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("key").alias("lo"), F.max("key").alias("hi")), "sizes")
    targets = source_targets(sizes.select("source", "source_size"), weights, share, ceiling)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = scratch.write(plan, "plan")

    # the range of keys, with what lies before it, in which each source's rest ends
    edge = plan.where("rest > 0").join(sizes.select(F.col("source").alias("own"), "lo", "hi"), F.col("source").eqNullSafe(F.col("own")))
    edge = scratch.write(edge.select("source", "rest", "lo", "hi", F.lit(0).cast("long").alias("before"), (F.col("lo") == F.col("hi")).alias("done")), "edge0")

    def inside(ranges: DataFrame) -> DataFrame:
        r = small(ranges.withColumnRenamed("source", "own"))
        return keyed.join(r, keyed["source"].eqNullSafe(r["own"]) & keyed["key"].between(r["lo"], r["hi"])).drop("own")

    step = 0
    while edge.where("NOT done").limit(1).count():
        step += 1
        part = F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES), F.lit(RANGES - 1))
        sums = inside(edge.where("NOT done")).groupBy("source", "rest", "before", part.alias("part")).agg(F.sum("size").alias("own"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("own").over(earlier), F.lit(0)))
        last = sums.where("before < rest").groupBy("source").agg(F.max_by(F.struct("rest", "lo", "hi", "before", ((F.col("n") <= FEW) | (F.col("lo") == F.col("hi"))).alias("done")), "part").alias("x"))
        edge = scratch.write(edge.where("done").unionByName(last.select("source", "x.*")), f"edge{step}")

    # rows of one key share their fate; the last key taken is the one whose middle lies before the rest's end
    by_key = inside(edge).groupBy("source", "rest", "before", "hi", "key").agg(F.sum("size").alias("own"))
    prior = F.col("before") + F.coalesce(F.sum("own").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_key = by_key.withColumn("out", F.when(prior + F.col("own") / 2.0 > F.col("rest"), F.col("key")))
    stops = by_key.groupBy("source").agg(F.coalesce(F.min("out"), F.max("hi")).alias("stop"), F.min("out").isNull().alias("stop_in"))
    stops = stops.withColumnRenamed("source", "own")
    full = plan.join(stops, F.col("source").eqNullSafe(F.col("own")), "left").drop("own", "rest")
    return scratch.write(full, "full_plan")


def _times(size: Column, key: Column, plan: Column) -> Column:
    """How often a row is taken, by the struct ``plan`` of its source's epochs, stop and stop_in."""
    extra = F.coalesce((key < plan["stop"]) | ((key == plan["stop"]) & plan["stop_in"]), F.lit(False))
    return F.when(size > 0, plan["epochs"] + extra.cast("long")).otherwise(0)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 11,
    weight: Callable[[Column], Column] = quality_weight,
) -> DataFrame:
    """(id, source, size, source_size, target, taken) of each row of ``docs``.

    size counts the text's words (null or empty: 0); taken is size times the whole epochs of the source, and
    once more for the documents that the fractional part takes. The last of these is the one whose middle lies
    before the rest's end, so a source misses its target by half a document at most; rows that repeat both id and
    text share one fate. Rows of size 0 take 0. A null source is a source; a very long text counts whole. Two runs
    agree, as keys come from hashes. ``weight`` is the quality of a text by which documents are preferred. An
    empty table gives an empty result; other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(text).alias("size"), sampling_key(F.col(id_col), text, seed, weight).alias("key"))
    keyed = scratch.write(keyed, "keyed")
    plan = sampling_plan(keyed.select("source", "size", "key"), scratch, weights, share, ceiling)
    plan = small(plan.select(F.col("source").alias("own"), "source_size", "target", F.struct("epochs", "stop", "stop_in").alias("plan")))
    rows = keyed.join(plan, F.col("source").eqNullSafe(F.col("own")))
    taken = F.col("size") * _times(F.col("size"), F.col("key"), F.col("plan"))
    return rows.select("id", "source", "size", "source_size", "target", taken.alias("taken"))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = mix(docs)
    return found.select(
        F.col("id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken")
    )


def take_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 11,
    weight: Callable[[Column], Column] = quality_weight,
) -> DataFrame:
    """``docs`` as ``mix`` takes it: a document that several epochs take comes as often; one not taken goes.

    Columns stay as they are, whatever their names. Every row is decided by its own text and its source's row of the
    plan, so no text is shuffled. Rows without words go; other cases are those of ``mix``.
    """
    scratch = Scratch(docs.sparkSession, "mix-taken")
    text = F.col(text_col).cast("string")
    size, key = size_of(text), sampling_key(F.col(id_col), text, seed, weight)
    keyed = scratch.write(docs.select(F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key")), "keyed")
    plan = sampling_plan(keyed, scratch, weights, share, ceiling)
    own, n, drawn, found, times, copy = free_names(docs, "_own", "_size", "_key", "_plan", "_times", "_copy")
    plan = small(plan.select(F.col("source").alias(own), F.struct("epochs", "stop", "stop_in").alias(found)))
    rows = docs.withColumns({n: size, drawn: key}).join(plan, F.col(source_col).cast("string").eqNullSafe(F.col(own)))
    rows = rows.withColumn(times, _times(F.col(n), F.col(drawn), F.col(found)).cast("int")).where(F.col(times) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
