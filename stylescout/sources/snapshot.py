"""A snapshot of an index on disk: a base and deltas, listed in a log of commits.

A commit writes its rows to a folder of its own under ``data`` and then one small file, ``log/<version>.json``, that names the folder. The file is
created only if no other writer has taken that version: then the commit fails as a whole, and its writer reads and merges again. Readers see the
state before a commit or after it; folders that no log entry names are never read.

A delta holds all rows of the files it touches. A reader takes a file's rows from the last commit that has the file. ``compact`` writes what a reader sees
as a new base; ``remove_old`` deletes what no reader of the last states can need. A file without class rows has one mark row, with the
time it was deleted or found without classes; it keeps later arrivals of older events out.

Creation has to be exclusive, as it is on HDFS and local disks; on a store where it is not, one writer at a time may commit.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylescout.plans.shared import small

SNAPSHOT = "file string, class string, emit_seq bigint, line int, column int, context string, mtime_ms bigint, deleted boolean"
_LOG = "version long, folder string, base boolean, include string, exclude string"
#: Deltas that a reader merges at most before a writer compacts them.
MOST_DELTAS = 16
#: How long folders that no log entry names are kept, for writers that have not committed yet.
ORPHAN_MS = 24 * 3600 * 1000


class Conflict(RuntimeError):
    """Another writer has committed first."""


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _append(spark: SparkSession, path: str, entry: dict) -> None:
    fs, at = _files(spark, f"{path}/log/{entry['version']:012}.json")
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        if fs.exists(at):
            raise Conflict(f"version {entry['version']} of {path} is taken") from e
        raise
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()


def create_snapshot(spark: SparkSession, path: str, include: str, exclude: tuple[str, ...]) -> None:
    """An empty snapshot; one that is there already is replaced."""
    for part in ("log", "data"):
        fs, at = _files(spark, f"{path}/{part}")
        fs.delete(at, True)
    _append(spark, path, {"version": 0, "folder": None, "base": True, "include": include, "exclude": ",".join(exclude)})


def log(spark: SparkSession, path: str) -> list[dict]:
    """The commits from the last base on: 1 + MOST_DELTAS or so, as writers compact."""
    rows = spark.read.schema(_LOG).json(f"{path}/log").filter("version is not null").orderBy("version")
    entries = [r.asDict() for r in rows.collect()]
    last = max(i for i, e in enumerate(entries) if e["base"])
    return entries[last:]


def version(spark: SparkSession, path: str) -> int:
    return log(spark, path)[-1]["version"]


def manifest(spark: SparkSession, path: str) -> dict:
    """The globs the snapshot was made with."""
    return {k: log(spark, path)[0][k] for k in ("include", "exclude")}


def read_snapshot(spark: SparkSession, path: str, entries: list[dict] | None = None) -> DataFrame:
    """All rows, marks too, of the last state (or that of the given log())."""
    entries = [e for e in entries or log(spark, path) if e["folder"]]
    if not entries:
        return spark.createDataFrame([], SNAPSHOT)
    names = [f.split()[0] for f in SNAPSHOT.split(", ")]
    rows = spark.read.schema(f"{SNAPSHOT}, folder string").parquet(f"{path}/data").filter(F.col("folder").isin([e["folder"] for e in entries]))
    deltas = [e for e in entries if not e["base"]]
    if not deltas:
        return rows.select(*names)
    order = F.create_map(*(F.lit(x) for e in entries for x in (e["folder"], e["version"])))
    rows = rows.withColumn("version", order[F.col("folder")])
    touched = rows.filter(F.col("folder").isin([e["folder"] for e in deltas])).groupBy("file").agg(F.max("version").alias("last"))
    return rows.join(small(touched), "file", "left").filter("last is null or version = last").select(*names)


def commit(rows: DataFrame, path: str, after: int, base: bool = False) -> None:
    """The rows' files, each with all its rows, as the version behind ``after``, which the writer has read; Conflict if it is not the last any more."""
    spark = rows.sparkSession
    names = [f.split()[0] for f in SNAPSHOT.split(", ")]
    folder = f"f{uuid.uuid4().hex}"
    made = manifest(spark, path)
    rows.select(*names).write.parquet(f"{path}/data/folder={folder}")
    _append(spark, path, {"version": after + 1, "folder": folder, "base": base, **made})


def compact(spark: SparkSession, path: str, most_deltas: int = 0) -> bool:
    """Writes the last state as a base if there are more deltas than that; False if there are not, or another writer was first."""
    entries = log(spark, path)
    if len(entries) - 1 <= most_deltas:
        return False
    try:
        commit(read_snapshot(spark, path, entries).repartition("file"), path, entries[-1]["version"], base=True)
    except Conflict:
        return False
    return True


def remove_old(spark: SparkSession, path: str, keep_bases: int = 1, orphan_ms: int = ORPHAN_MS) -> int:
    """Deletes the commits before the last ``keep_bases`` bases, and folders of that age that no commit names. How many folders are gone.

    A reader that began before those bases were written may still need what goes: keep as many as readers may lag behind.
    """
    entries = [r.asDict() for r in spark.read.schema(_LOG).json(f"{path}/log").filter("version is not null").orderBy("version").collect()]
    bases = [i for i, e in enumerate(entries) if e["base"]]
    first = bases[max(0, len(bases) - keep_bases)]
    named = {e["folder"] for e in entries}
    kept = {e["folder"] for e in entries[first:]}
    fs, _ = _files(spark, path)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    # the log first: what no entry names is not read
    for e in entries[:first]:
        fs.delete(at(f"{path}/log/{e['version']:012}.json"), False)
    gone = 0
    if fs.exists(at(f"{path}/data")):
        for status in fs.listStatus(at(f"{path}/data")):
            folder = status.getPath().getName().removeprefix("folder=")
            if folder not in kept and (folder in named or time.time() * 1000 - status.getModificationTime() > orphan_ms):
                gone += fs.delete(status.getPath(), True)
    return gone
