"""Bronze by each file's own header: columns that nobody agreed on are rescued as JSON, never lost and never let in.

A first stream takes up the new files and notes each one's header. A second one reads their lines, joined to the header
of the line's file, and places the cells by name: agreed columns under their names, a missing one as null, the other
cells as JSON in ``_rescued_data``, as is the whole line of a row with too many or too few cells. Both streams keep
track of what they did, and bronze is written by a sink that lists whole batches only.
"""

from __future__ import annotations

import csv
import io

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitLog

_UNKNOWN = "header not read yet"
#: Under which a row that does not fit its header is rescued.
WHOLE_LINE = "_line"


def _header(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """A file's first line and the names in it, each once: further columns of a name, or without one, get their number."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()
    names: list[str] = []
    line = line.removeprefix("\ufeff")  # a mark of the byte order, which Spark's reader leaves out as well
    for k, name in enumerate(next(csv.reader(io.StringIO(line)), [])):
        names.append(f"{name}#{k + 1}" if name in (*names, "", WHOLE_LINE) else name)
    return line, names


def _note_headers(spark: SparkSession, landing: str, out: str, files_per_batch: int) -> CommitLog:
    """Note the header of each file that came since the last time; only the listing is read, and one line of each file."""
    log = CommitLog(spark, f"{out}/_headers")

    def note(files: DataFrame, number: int) -> None:
        if not log.has(number):
            paths = [r["path"] for r in files.collect()]  # files_per_batch at most
            log.commit(number, folder="", files=[[p, *_header(spark, p)] for p in paths])

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(landing)
    names = files.select(F.col("_metadata.file_path").alias("path"))
    names.writeStream.foreachBatch(note).option("checkpointLocation", f"{out}/_state_headers").trigger(availableNow=True).start().awaitTermination()
    return log


def _cells(line: Column, widths: list[int]) -> Column:
    """Cells of a line as many as its header has (column ``n``), and the line itself where it has more or fewer."""

    def of_width(n: int) -> Column:
        names = [f"c{k}" for k in range(n)]
        row = F.from_csv(line, ", ".join(f"{c} string" for c in names) + ", _bad string", {"escape": '"', "columnNameOfCorruptRecord": "_bad"})
        return F.transform(F.array(row), lambda r: F.struct(F.array(*[r[c] for c in names]).alias("cells"), r["_bad"].alias("bad")))[0]

    parsed = F.lit(None).cast("struct<cells:array<string>,bad:string>")
    for n in widths:
        parsed = F.when(F.col("n") == n, of_width(n)).otherwise(parsed)
    return parsed


def by_own_header(lines: DataFrame, headers: DataFrame, widths: list[int], columns: list[str]) -> DataFrame:
    """``columns`` and _rescued_data from lines (value, path, start) and headers (path, first, names)."""
    known = lines.join(headers, "path", "left")
    seen = F.when(F.col("names").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{_UNKNOWN}: "), "path")).cast("boolean"))
    # a file's first block begins with its header
    rows = known.where(seen & (F.col("value") != "") & ~((F.col("start") == 0) & (F.col("value") == F.col("first"))))
    rows = rows.withColumn("n", F.size("names")).withColumn("p", _cells(F.col("value"), widths)).withColumn("bad", F.col("p.bad"))
    cell = lambda name: F.try_element_at("p.cells", F.nullif(F.array_position("names", name), F.lit(0)).cast("int"))
    pairs = F.zip_with("names", "p.cells", lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    other = F.filter(pairs, lambda x: ~x["k"].isin(columns) & x["v"].isNotNull())
    kept = F.map_from_arrays(F.transform(other, lambda x: x["k"]), F.transform(other, lambda x: x["v"]))
    whole = F.when(F.col("bad").isNotNull(), F.create_map(F.lit(WHOLE_LINE), F.col("bad"))).otherwise(F.create_map().cast("map<string,string>"))
    rescued = F.map_concat(kept, whole)
    return rows.select(*[cell(c).alias(c) for c in columns], F.when(F.size(rescued) > 0, F.to_json(rescued)).alias("_rescued_data"), "_source_file", "_ingested_at")


def bronze_rescued(spark: SparkSession, landing: str, out: str, columns: list[str], files_per_batch: int = 1000) -> None:
    """Append every new file in ``landing`` once, all text, placed by its own header, with what was rescued, its file name and arrival time.

    Names are compared as written. Empty lines, and repetitions of the header in a file's first block, are no rows. A
    file without a line has no rows. Whether rescued rows stop the update is for the fail rules of what reads bronze.
    """
    for attempt in (1, 2, 3):
        entries, done = _note_headers(spark, landing, out, files_per_batch).entries(), CommitLog(spark, f"{out}/_headers_done")
        before = max((e["batch"] for e in done.entries()), default=-1)  # files noted up to here are in bronze
        noted = {p: (first, names) for e in entries if e["batch"] > before for p, first, names in e["files"]}
        headers = spark.createDataFrame([(p, f, n) for p, (f, n) in noted.items()], "path string, first string, names array<string>")
        source = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(landing)
        lines = source.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_name").alias("_source_file"), F.current_timestamp().alias("_ingested_at"))
        rows = by_own_header(lines, headers, sorted({len(n) for _, n in noted.values()} - {0}), columns).withColumn("_row_id", F.expr("uuid()"))
        try:
            rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/_state_bronze").trigger(availableNow=True).start(f"{out}/bronze").awaitTermination()
            if noted:
                done.commit(entries[-1]["batch"])
            return
        except StreamingQueryException as e:  # a file that came after the headers were noted: note it and go on
            if attempt == 3 or _UNKNOWN not in str(e):
                raise
