"""A log of committed batches: what a batch wrote counts once its entry is in the log, all of it or none.

An entry is a small JSON file that appears under its final name by a rename, so a reader sees it whole or not at all.
A batch writes to a folder of its own name, new at each attempt; folders that no entry names are leftovers of attempts
that ended early, which nobody reads and ``sweep`` removes. Every COMPACT entries the log is written anew as one file.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..sources.shared import Files

COMPACT = 50


class CommitLog:
    """Entries by batch number, in ``folder``; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files = Files(spark, folder)

    def entries(self) -> list[dict]:
        """Committed entries by batch: those of the last compacted file and all later ones."""
        names = [n for n in self.files.names() if not n.startswith(".")]
        whole = max((n for n in names if n.endswith(".all")), default=None)
        found = json.loads(self.files.read(whole)) if whole else []
        last = found[-1]["batch"] if found else -1
        later = sorted(n for n in names if n.endswith(".json") and int(n[:-5]) > last)
        return found + [json.loads(self.files.read(n)) for n in later]

    def has(self, batch: int) -> bool:
        return self.files.exists(f"{batch:012d}.json")

    def commit(self, batch: int, **entry) -> None:
        self.files.publish(f"{batch:012d}.json", json.dumps({"batch": batch, **entry}))
        if batch and batch % COMPACT == 0 and not self.files.exists(f"{batch:012d}.all"):
            self.files.publish(f"{batch:012d}.all", json.dumps(self.entries()))

    def clear(self) -> None:
        self.files.delete()


def sweep(spark: SparkSession, log: CommitLog, root: str) -> list[str]:
    """Remove the folders under ``root`` that no entry of the log names; run it while no batch is being written."""
    files, named = Files(spark, root), {e["folder"] for e in log.entries()}
    gone = [n for n in files.names() if n not in named]
    for n in gone:
        files.delete(n)
    return gone
