"""Keeping an index snapshot up to date from a stream of file changes (file, op, source, mtime_ms, event_ts, seq).

The state is the snapshot itself, the one that ``save_index`` writes and ``load_index`` reads. A micro-batch takes the last event of each file,
extracts what was written, and commits the files it touches as a delta; replaying a batch gives the same state. A batch that another
writer overtakes is merged again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stylescout.plans.shared import durable, small, stored
from stylescout.sources import snapshot as P
from stylescout.sources.corpus import EXCLUDE, INCLUDE, excluded, extract_classes, marked_rows

#: Times that a batch is merged again because other writers were first.
TRIES = 20


def create_snapshot(spark: SparkSession, path: str, include: str = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> None:
    """An empty snapshot."""
    P.create_snapshot(spark, path, include, exclude)


def latest_events(changes: DataFrame, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """The last event of each file that is not excluded."""
    order = Window.partitionBy("file").orderBy(F.desc("event_ts"), F.desc("seq"))
    return changes.filter(~excluded(F.col("file"), exclude)).withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


def merge_changes(snapshot: DataFrame, last: DataFrame, extract: Callable[[DataFrame], DataFrame] = extract_classes) -> DataFrame:
    """Snapshot rows of the files that the last events change. An event older than what the snapshot knows of its file, a deletion included, is ignored."""
    known = snapshot.select("file", "mtime_ms").join(small(last.select("file")), "file", "left_semi").groupBy("file").agg(F.max("mtime_ms").alias("known_ms"))
    fresh = durable(last.join(known, "file", "left").filter("known_ms is null or mtime_ms >= known_ms").drop("known_ms"))
    upserts = fresh.filter("op <> 'delete'")
    return marked_rows(extract(upserts.select("file", "source")), fresh.select("file", "mtime_ms", (F.col("op") == "delete").alias("deleted")))


def apply_batch(changes: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame] = extract_classes) -> None:
    """One micro-batch: what it changes is committed as a delta; the snapshot is compacted once it has many."""
    spark = changes.sparkSession
    last = durable(latest_events(changes, tuple(filter(None, P.manifest(spark, path)["exclude"].split(",")))))
    for _ in range(TRIES):
        entries = P.log(spark, path)
        rows = stored(merge_changes(P.read_snapshot(spark, path, entries), last, extract))
        if rows.isEmpty():
            return
        try:
            P.commit(rows, path, entries[-1]["version"])
        except P.Conflict:
            continue
        P.compact(spark, path, P.MOST_DELTAS)
        return
    raise P.Conflict(f"{path}: other writers were first {TRIES} times")


def start(changes: DataFrame, path: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame] = extract_classes, **trigger):
    """Runs the stream into the snapshot at ``path``; trigger as for DataFrameWriter streams, by default all that is available, then an end."""
    return changes.writeStream.foreachBatch(lambda batch, _: apply_batch(batch, path, extract)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
