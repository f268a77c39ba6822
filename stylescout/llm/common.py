"""What the corpus operators share: durable cuts of the lineage, table access, text helpers for tasks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: White space that separates words: blank and U+0009 to U+000D.
SPACES = "\\x20\\x09-\\x0D"
#: Characters of text a task turns into arrays at a time; a longer single text is one block of its own.
BLOCK_CHARS = 4_000_000
#: Distinct words a Python worker remembers before it starts afresh.
MEMO_WORDS = 400_000
#: The same where a word is cheap to work out again.
CHEAP_WORDS = 200_000
_NOTED: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts in few files is dealt over all cores (large ones have more files than there are cores, and stay)."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in ("documents", "pages"):
        return rows
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where none is set and all tasks run on this machine, a fresh temporary one, set once per session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """A small or middling table, materialised in the shared folder: later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df`` in as many tasks as its about ``rows`` rows need, one for each core at least; what a large table has in tasks stays.

    For joins of small tables in rounds: a job's tasks, files and log else grow with the number of shuffle partitions, not with the rows.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def counted(df: DataFrame, most: int | None = None, each: int = 50_000) -> tuple[DataFrame, int]:
    """durable(), in about as many partitions as its rows need, and the number of these: small tables that are shuffled again and again leave few files.

    With ``most``, about how many rows there can be, no more tasks than that write it.
    """
    out = durable(df if most is None else few(df, most, each))
    rows = out.count()
    return out.coalesce(max(1, -(-rows // each))), rows


def compact(df: DataFrame, most: int | None = None) -> DataFrame:
    """counted() without the number."""
    return counted(df, most)[0]


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """A large table written as Parquet to the shared folder and read back; noted by noting(), unless it is to be kept."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if _NOTED and not keep:
        _NOTED[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def noting(paths: list[str]):
    """Within this, stored() adds the paths of its tables to ``paths``."""
    _NOTED.append(paths)
    try:
        yield
    finally:
        _NOTED.pop()


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that stored() has written, and empties the list. For when what reads them is written itself."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(names: list[str]) -> list[str]:
    """Column names that select() takes as they are, whatever characters they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A schema, whatever its names, with further fields."""
    return StructType([StructField(f.name, f.dataType) for f in [*schema.fields, *StructType.fromDDL(ddl).fields]])


def crc_bucket(doc_id) -> "F.Column":
    """crc32 of the id as text, modulo 4; rows with remainder 2 are held out. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def blocks(texts: list, limit: int = BLOCK_CHARS):
    """Slices (first, last) of a batch such that each holds about ``limit`` characters at most, or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def text_blocks(column: pa.Array, limit: int = BLOCK_CHARS):
    """(first row, texts) of slices of a column that hold about ``limit`` bytes at most, or one text; only one is turned into objects at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, column.slice(start, end - start).to_pylist()
        start = end


class Memo(dict):
    """word -> dense number; ``fresh`` lists the words numbered since the last call of take()."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def take(self) -> list:
        fresh, self.fresh = self.fresh, []
        return fresh
