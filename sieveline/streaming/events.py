"""The event log of updates: a listener writes what each micro-batch observed, as nested JSON, while the stream runs."""

from __future__ import annotations

import json
import threading
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.shared import Files

#: Named counts of a stream's rows: ``observe(DATASET_PREFIX + dataset, ...)`` with ROWS and one count of failures a rule.
DATASET_PREFIX, ROWS = "expectations of ", "_rows"
SCHEMA = "id string, timestamp timestamp, event_type string, origin struct<update_id: string, query_id: string, run_id: string, batch_id: bigint>, details string"
_EXPECTATIONS = "$.flow_progress.data_quality.expectations"
_ROW = "array<struct<name: string, dataset: string, passed_records: bigint, failed_records: bigint>>"


class EventLog(StreamingQueryListener):
    """Writes an event when an update begins, after each batch, and when a query ends. Use it as a context:

    ``with EventLog(spark, folder) as events: ...`` adds the listener, and on leaving waits until the events of all
    queries that it saw start are written. An event is a file of its own that appears whole. A batch that ran but whose
    driver died before the event is missing here; what must not be missing stands in the commit log.
    """

    def __init__(self, spark: SparkSession, folder: str, update_id: str | None = None, patience: float = 60.0):
        self.spark, self.folder, self.update_id, self.patience = spark, folder, update_id or uuid.uuid4().hex, patience
        self._files, self._open, self._free = Files(spark, folder), set(), threading.Condition()
        self.errors: list[Exception] = []

    def __enter__(self) -> EventLog:
        self._write("create_update", {}, {})
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        with self._free:
            self._free.wait_for(lambda: not self._open, self.patience)
        self.spark.streams.removeListener(self)

    def _write(self, kind: str, origin: dict, details: dict) -> None:
        name = uuid.uuid4().hex
        now = datetime.now(timezone.utc).isoformat(timespec="microseconds")
        event = {"id": name, "timestamp": now, "event_type": kind, "origin": {"update_id": self.update_id, **origin}, "details": json.dumps(details)}
        self._files.publish(f"{name}.json", json.dumps(event))

    def onQueryStarted(self, event) -> None:
        with self._free:
            self._open.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = []
        for name, row in p.observedMetrics.items():
            counts = row.asDict()
            if name.startswith(DATASET_PREFIX) and (total := counts.pop(ROWS)) is not None:
                found += [{"name": n, "dataset": name.removeprefix(DATASET_PREFIX), "passed_records": total - k, "failed_records": k} for n, k in counts.items()]
        details = {"flow_progress": {"metrics": {"num_input_rows": p.numInputRows, "milliseconds": dict(p.durationMs)}, "data_quality": {"expectations": found}}}
        self._safe("flow_progress", {"query_id": str(p.id), "run_id": str(p.runId), "batch_id": p.batchId}, details)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._safe("query_ended", {"query_id": str(event.id), "run_id": str(event.runId)}, {"exception": event.exception})
        with self._free:
            self._open.discard(str(event.runId))
            self._free.notify_all()

    def _safe(self, *event) -> None:
        try:
            self._write(*event)
        except Exception as e:  # a listener must not throw; the caller sees it here
            self.errors.append(e)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(folder)


def expectation_metrics(events: DataFrame, update_id: str | None = None) -> DataFrame:
    """(dataset, expectation, passed, failed) of one update, the one that began last unless another is named.

    An event of a batch that a restarted query ran again is counted once, by its latest event.
    """
    if update_id is None:
        last = events.where("event_type = 'create_update'").agg(F.max_by("origin.update_id", F.struct("timestamp", "id")).alias("update"))
        own = events.join(F.broadcast(last), F.col("origin.update_id") == F.col("update"), "left_semi")
    else:
        own = events.where(F.col("origin.update_id") == update_id)
    of_batch = own.where("event_type = 'flow_progress'").groupBy("origin.query_id", "origin.batch_id").agg(F.max_by("details", "timestamp").alias("details"))
    each = of_batch.select(F.explode(F.from_json(F.get_json_object("details", _EXPECTATIONS), _ROW)).alias("e")).select("e.*")
    return each.groupBy("dataset", F.col("name").alias("expectation")).agg(F.sum("passed_records").alias("passed"), F.sum("failed_records").alias("failed"))
