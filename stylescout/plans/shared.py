"""The folder that all executors share, tables cut from their lineage there, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

BROADCAST_BYTES = 32_000_000
#: Hits of a file are many times its text, so sources that are dealt by file go to so many tasks for each task of their scan.
FILE_TASKS = 8
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a fresh temporary one where none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """A large table written as Parquet to the shared folder and read back."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Deletes what this session has written to the shared folder, but for checkpoints (Spark's cleaner has these). For when results are written."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its rows and strings come to at most ``BROADCAST_BYTES``; a join by key serves larger ones. Read twice."""
    texts = [F.coalesce(F.octet_length(F.array_join(c, "") if kind == "array<string>" else c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "array<string>")]
    size = df.agg(F.sum(sum(texts, F.lit(40 + 8 * len(df.columns))).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def numbered(df: DataFrame, key: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) among the rows of its key, in the given order; df is read twice.

    Rows are sorted by key and order over ranges, so a hot key lies in many tasks: each numbers its own rows, and the rows of the range's first
    key start behind those that earlier ranges have of it. The driver sees two numbers for each range.
    """
    rows = durable(df.withColumn("_key", F.xxhash64(*key)).repartitionByRange(*key, *order).sortWithinPartitions(*key, *order))

    def edges(batches):
        first, last, n = None, None, 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            if len(keys):
                first = keys[0] if first is None else first
                run = len(keys) - int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])
                n = n + run if run == len(keys) and keys[-1] == last else run
                last = keys[-1]
        if first is not None:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "first": [first], "last": [last], "n": [n]})

    starts: dict[int, int] = {}
    last, n = None, 0
    for r in sorted(rows.select("_key").mapInArrow(edges, "part long, first long, last long, n long").collect()):  # a row for each range
        starts[r["part"]] = n if r["first"] == last else 0
        n = r["n"] + (n if r["last"] == last else 0)
        last = r["last"]

    def number(batches):
        held, n = None, starts.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_numpy()
            if len(keys):
                new = np.append(held is not None and keys[0] != held, keys[1:] != keys[:-1])
                at = np.arange(len(keys))
                place = at - np.maximum.accumulate(np.where(new, at, 0))
                place[np.cumsum(new) == 0] += n
                held, n = keys[-1], int(place[-1]) + 1
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(place, pa.int64())], [*batch.schema.names[:-1], name])

    return rows.mapInArrow(number, StructType([*df.schema.fields]).add(name, LongType()))


def by_file(sources: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """``sources`` (file...) dealt by file once, in FILE_TASKS tasks for each of their scan: windows, groups and joins of what is made of a file stay in its task."""
    tasks = FILE_TASKS * (sources if scan is None else scan).rdd.getNumPartitions()
    return sources.repartition(max(sources.sparkSession.sparkContext.defaultParallelism, tasks), "file")


def spread(scan: DataFrame) -> DataFrame:
    """``scan`` dealt over all cores where its files make fewer tasks than there are cores; otherwise, as for any large table, as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
