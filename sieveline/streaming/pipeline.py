"""Bronze, silver, quarantine and gold over delivered CSV files, as Structured Streaming with rules and validation."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import convert, text
from ..operators import quality
from ..sources import tables
from ..sources.shared import Files
from . import commits, events

#: What a review names a quarantined row by.
REVIEW_KEY = ["_source_file", "id_written"]
#: Given to a row once, when bronze takes it up.
ROW_ID = "_row_id"
RESULTS = "run_id string, check_name string, value double, threshold double, status string, checked_at timestamp"


def bronze(spark: SparkSession, landing: str, out: str, columns: list[str]) -> None:
    """Append every new file in ``landing`` once, all text, with its file name, arrival time, any row that breaks the layout, and a row id.

    A file whose header is not exactly ``columns``, in this order, stops the update.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_rescued_data"]])
    files = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"').option("columnNameOfCorruptRecord", "_rescued_data").csv(landing)
    rows = files.withColumns({"_source_file": F.col("_metadata.file_name"), "_ingested_at": F.current_timestamp(), ROW_ID: F.expr("uuid()")})
    rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/_state_bronze").trigger(availableNow=True).start(f"{out}/bronze").awaitTermination()


def enforced(rows: DataFrame, fail: dict[str, str]) -> DataFrame:
    """``rows``; the first row that breaks a named SQL rule stops the job that reads it. A rule that is null holds."""
    for name, rule in fail.items():
        rows = rows.where(F.when(F.coalesce(F.expr(rule), F.lit(True)), F.lit(True)).otherwise(F.raise_error(F.lit(f"rule broken: {name}")).cast("boolean")))
    return rows


def silver(spark: SparkSession, out: str, id_col: str, cleanse: Callable[[DataFrame], DataFrame], warn: dict[str, str], fail: dict[str, str], second_id: str | None = None, files_per_batch: int = 1000, repeats: str | None = None) -> None:
    """Split bronze by the ID rule: good rows cleansed to silver, the others stripped to quarantine, rule counts by batch.

    ``cleanse`` may join static tables. A batch is written once, silver and quarantine as two parts of one folder, and
    counts from the moment that its entry, which also holds the rules' counts, is in the commit log: ``read`` sees all
    of a batch or nothing, and a batch that runs again after that is left as it is. A broken fail rule stops the stream
    before anything of its batch is committed. The log and the stream's state belong together; ``full_refresh`` removes both.
    What a batch observed also goes to listeners, as ``events.EventLog`` writes it.

    With ``repeats``, a time like '30 days', the stream's state remembers each ID for that long after its last arrival,
    by ``_ingested_at``: the first row of an ID goes to silver, any later one of whatever delivery to quarantine, as
    'repeated'. ``cleanse`` must then keep columns that it does not know.
    """
    log = commits.CommitLog(spark, f"{out}/_commits")
    schema = spark.read.parquet(f"{out}/bronze").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{out}/bronze")
    clean = text.strip_and_null(source)
    clean = enforced(clean.withColumn("_id_problem", convert.id_problem(F.col(id_col), None if second_id is None else F.col(second_id))), fail)
    counts = [F.count("*").alias(events.ROWS), *[F.count_if(~F.expr(r)).alias(n) for n, r in warn.items()]]
    good = cleanse(clean.where("_id_problem IS NULL").drop("_id_problem")).observe(f"{events.DATASET_PREFIX}silver", *counts)
    held = clean.where("_id_problem IS NOT NULL").select(F.struct("*").alias("_held"))
    held = held.observe(f"{events.DATASET_PREFIX}quarantine", F.count("*").alias(events.ROWS))
    if repeats:
        return _silver_once(spark, out, id_col, cleanse, warn, clean, repeats)
    both = good.unionByName(held, allowMissingColumns=True).withColumn("_part", F.when(F.col("_held").isNull(), "silver").otherwise("quarantine"))
    shapes = {"silver": good.schema.json(), "quarantine": held.schema.json()}

    def batch(rows: DataFrame, number: int) -> None:
        if log.has(number):
            return
        folder, seen = f"batch={number}-{uuid.uuid4().hex}", Observation()
        is_good = F.col("_held").isNull()
        failures = [F.count_if(is_good & ~F.expr(r)).alias(n) for n, r in warn.items()]
        rows.observe(seen, F.count_if(is_good).alias("_good"), F.count_if(~is_good).alias("_held"), *failures).write.partitionBy("_part").parquet(f"{out}/batches/{folder}")
        found = seen.get
        log.commit(number, folder=folder, rows={"silver": found["_good"], "quarantine": found["_held"]}, failing={n: found[n] for n in warn}, shapes=shapes)

    both.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/_state_silver").trigger(availableNow=True).start().awaitTermination()


def _silver_once(spark: SparkSession, out: str, id_col: str, cleanse: Callable[[DataFrame], DataFrame], warn: dict[str, str], clean: DataFrame, repeats: str) -> None:
    """``silver`` with repeated IDs kept out: first rows by the state store, all rows beside them, matched batch by batch."""
    log = commits.CommitLog(spark, f"{out}/_commits")
    valid = clean.where("_id_problem IS NULL")
    first = valid.select(id_col, "_ingested_at", ROW_ID).withWatermark("_ingested_at", repeats).dropDuplicatesWithinWatermark([id_col])
    whole = clean.select(F.struct("*").alias("_held"))
    both = whole.unionByName(first.select(F.col(ROW_ID).alias("_first")), allowMissingColumns=True)

    def batch(rows: DataFrame, number: int) -> None:
        if log.has(number):
            return
        folder, staged = f"batch={number}-{uuid.uuid4().hex}", f"{out}/_staged/{number}-{uuid.uuid4().hex}"
        rows.write.parquet(staged)  # a batch of a stream with state is run once
        # in the stream's own session: one that has observed something can no longer ship the models that refer to it
        kept = rows.sparkSession.read.schema(rows.schema).parquet(staged)
        firsts = kept.where("_first IS NOT NULL").select(F.col("_first").alias(ROW_ID))
        there = kept.where("_held IS NOT NULL").select("_held.*")
        once = there.where("_id_problem IS NULL").join(firsts, ROW_ID, "left_semi")
        again = there.where("_id_problem IS NULL").join(firsts, ROW_ID, "left_anti").withColumn("_id_problem", F.lit("repeated"))
        good, seen = cleanse(once.drop("_id_problem")), Observation()
        held = there.where("_id_problem IS NOT NULL").unionByName(again).select(F.struct(*there.columns).alias("_held"))
        shapes = {"silver": good.schema.json(), "quarantine": held.schema.json()}
        every = good.unionByName(held, allowMissingColumns=True).withColumn("_part", F.when(F.col("_held").isNull(), "silver").otherwise("quarantine"))
        is_good = F.col("_held").isNull()
        failures = [F.count_if(is_good & ~F.expr(r)).alias(n) for n, r in warn.items()]
        every.observe(seen, F.count_if(is_good).alias("_good"), F.count_if(~is_good).alias("_held"), *failures).write.partitionBy("_part").parquet(f"{out}/batches/{folder}")
        found = seen.get
        log.commit(number, folder=folder, rows={"silver": found["_good"], "quarantine": found["_held"]}, failing={n: found[n] for n in warn}, shapes=shapes)
        Files(spark, staged).delete()

    both.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/_state_silver").trigger(availableNow=True).start().awaitTermination()


_RULES = "check_name string, failing_records long, records long"


def read(spark: SparkSession, out: str, part: str, since: int = -1) -> DataFrame:
    """bronze, or silver, quarantine or rules (counts by batch) of the committed batches, those after ``since``."""
    if part == "bronze":
        return spark.read.parquet(f"{out}/bronze")
    entries = [e for e in commits.CommitLog(spark, f"{out}/_commits").entries() if e["batch"] > since]
    if part == "rules":
        return spark.createDataFrame([(n, k, e["rows"]["silver"]) for e in entries for n, k in e["failing"].items()], _RULES)
    if not entries:
        raise FileNotFoundError(f"no committed batch in {out}")
    shape = T.StructType.fromJson(json.loads(entries[-1]["shapes"][part]))
    paths = [f"{out}/batches/{e['folder']}/_part={part}" for e in entries if e["rows"][part]]
    found = spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)
    return found.select("_held.*") if part == "quarantine" else found


def expectation_counts(spark: SparkSession, out: str) -> DataFrame:
    """(check_name, passed, failed) of the warn rules over all batches."""
    by = read(spark, out, "rules").groupBy("check_name")
    return by.agg(F.sum(F.col("records") - F.col("failing_records")).alias("passed"), F.sum("failing_records").alias("failed"))


def gold(spark: SparkSession, out: str, views: dict[str, Callable[[DataFrame], DataFrame]], fail: dict[str, dict[str, str]] | None = None) -> None:
    """Compute each view from silver and replace it, unless a row breaks one of the view's fail rules (name -> SQL)."""
    rows = read(spark, out, "silver")
    for name, view in views.items():
        found = view(rows)
        rules = (fail or {}).get(name)
        (quality.gate(found, rules) if rules else found).write.mode("overwrite").parquet(f"{out}/gold/{name}")


def gold_incremental(spark: SparkSession, out: str, name: str, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> None:
    """Bring the state of a gold view up to the last committed batch, reading only the batches after those it has.

    ``partial`` aggregates rows of silver to state rows, ``merge`` unites state rows of equal keys; so the work follows
    the new rows and the groups, not all of silver. A count of distinct values is merged exactly where the state has a
    row for each group and value. The new state counts once its entry is in the view's own commit log.
    """
    silver_entries = commits.CommitLog(spark, f"{out}/_commits").entries()
    log = commits.CommitLog(spark, f"{out}/gold_state/{name}/_commits")
    mine = log.entries()
    since = mine[-1]["upto"] if mine else -1
    if not silver_entries or silver_entries[-1]["batch"] <= since:
        return
    upto = silver_entries[-1]["batch"]
    state = partial(read(spark, out, "silver", since))
    if mine:
        state = state.unionByName(spark.read.schema(state.schema).parquet(f"{out}/gold_state/{name}/{mine[-1]['folder']}"))
    folder, state = f"upto={upto}-{uuid.uuid4().hex}", merge(state)
    state.write.parquet(f"{out}/gold_state/{name}/{folder}")
    log.commit(len(mine), folder=folder, upto=upto)


def gold_state(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The committed state of a view."""
    last = commits.CommitLog(spark, f"{out}/gold_state/{name}/_commits").entries()[-1]
    return spark.read.parquet(f"{out}/gold_state/{name}/{last['folder']}")


def full_refresh(spark: SparkSession, out: str) -> None:
    """Forget silver, quarantine and rules, so that the next ``silver`` reads all of bronze again, as after a changed crosswalk."""
    for part in ("gold_state", "_commits", "_state_silver", "batches", "_staged"):
        Files(spark, f"{out}/{part}").delete()


def review(spark: SparkSession, out: str, rows: DataFrame) -> None:
    """Record reviews (_source_file, id as written, note, ...) of quarantined rows; one that is there already stays as it is."""
    tables.insert_absent(rows, f"{out}/reviews", REVIEW_KEY)


def unreviewed(spark: SparkSession, out: str, id_col: str) -> DataFrame:
    """Quarantined rows that no review names, a missing ID matched as an empty text."""
    q = read(spark, out, "quarantine").withColumn("id_written", F.coalesce(id_col, F.lit("")))
    seen = tables.read_log(spark, f"{out}/reviews", "_source_file string, id_written string, note string").select(*REVIEW_KEY)
    return q.join(seen, REVIEW_KEY, "left_anti")


def validate(spark: SparkSession, out: str, id_col: str, limits: dict[str, float], run_id: str = "run", default: float = 0.01, raises: bool = True, quarantine_id: str | None = None) -> DataFrame:
    """(run_id, check_name, value, threshold, status, checked_at): the results of this run, which are appended to ``out``/results.

    No row is lost between bronze, silver and quarantine; no ID repeats; every quarantined row is reviewed; each rule's
    failing share is within its limit. After the results are written a failure raises, unless told otherwise.
    """
    b, s, q = (read(spark, out, x) for x in ("bronze", "silver", "quarantine"))
    one = s.agg(F.count("*").alias("n"), (F.count(id_col) - F.count_distinct(id_col)).alias("repeated")).first()
    left = unreviewed(spark, out, quarantine_id or id_col).count()
    found = [("conservation", float(b.count() - q.count() - one["n"]), 0.0), ("repeated ids", float(one["repeated"]), 0.0), ("quarantined rows reviewed", float(left), 0.0)]
    for r in expectation_counts(spark, out).collect():
        found.append((r["check_name"], round(r["failed"] / max(1, one["n"]), 5), limits.get(r["check_name"], default)))
    rows = [(run_id, n, v, float(t), "PASS" if abs(v) <= t else "FAIL") for n, v, t in found]
    results = spark.createDataFrame(rows, RESULTS.removesuffix(", checked_at timestamp")).withColumn("checked_at", F.current_timestamp())
    tables.append_log(results, f"{out}/results")
    if raises and (failed := [f"{n} ({v})" for _, n, v, _, status in rows if status == "FAIL"]):
        raise AssertionError(f"{len(failed)} checks failed: {'; '.join(failed)}")
    return tables.read_log(spark, f"{out}/results", RESULTS).where(F.col("run_id") == run_id)
