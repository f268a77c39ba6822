"""Lines of different files with one and the same set of classes."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylescout.functions.text import basename
from stylescout.operators.index import file_chunks
from stylescout.plans.shared import stored

MIN_CLASSES = 3
MIN_FILES = 2
GROUP = ["signature", "classes"]


def line_class_sets(locations: DataFrame, min_classes: int = MIN_CLASSES) -> DataFrame:
    """file, line, classes (sorted, distinct), signature of lines with enough classes."""
    sets = locations.groupBy("file", "line").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    return sets.filter(F.size("classes") >= min_classes).select("file", "line", "classes", F.xxhash64("classes").alias("signature"))


def repeated_sets(locations: DataFrame, min_classes: int = MIN_CLASSES, min_files: int = MIN_FILES) -> DataFrame:
    """line_class_sets() of the lines that may be duplicates: the sets are stored once, and numbers of fixed size find those of several files."""
    sets = stored(line_class_sets(locations, min_classes))
    mark = [F.col("signature"), F.xxhash64(F.lit(1), "classes").alias("second"), F.size("classes").alias("n")]
    marks = ["signature", "second", "n"]
    often = sets.select("file", *mark).groupBy(*marks).agg(F.count_distinct("file").alias("k")).filter(F.col("k") >= min_files)
    return sets.select("*", *mark[1:]).join(often, marks, "left_semi").drop(*marks[1:])


def duplicate_groups(sets: DataFrame, min_files: int = MIN_FILES) -> DataFrame:
    """signature, classes, n_occurrences, n_files of sets in several files."""
    found = sets.groupBy("signature", "classes").agg(F.count("*").alias("n_occurrences"), F.count_distinct("file").alias("n_files"))
    return found.filter(F.col("n_files") >= min_files)


def duplicate_occurrences(sets: DataFrame, groups: DataFrame, contexts: DataFrame) -> DataFrame:
    """signature, file, line, context of every occurrence, in flat rows; contexts: file, line, context."""
    met = sets.join(groups.select("signature", "classes"), ["signature", "classes"], "left_semi").select("signature", "file", "line")
    return met.join(contexts, ["file", "line"]).select("signature", "file", "line", "context")


def occurrence_report(sets: DataFrame, groups: DataFrame, contexts: DataFrame) -> DataFrame:
    """A display row for each occurrence: its group's counts and classes, label (base name and 1-based line), file, line, context."""
    met = sets.select("signature", "classes", "file", "line").join(groups, GROUP).join(contexts, ["file", "line"])
    label = F.concat(basename(F.col("file")), F.lit(":"), (F.col("line") + 1).cast("string"))
    return met.select("n_occurrences", "n_files", "classes", label.alias("label"), "file", "line", "context")


def ordered_groups(groups: DataFrame) -> DataFrame:
    """Groups by falling occurrences and classes."""
    return groups.orderBy(F.desc("n_occurrences"), F.desc(F.size("classes")), "classes")


def duplicate_summary(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """The files of each group in order, in rows of bounded size: signature, classes, chunk (rising with the files), files, and
    the group's files, occurrences, class count and first six classes."""
    shown = F.concat(F.array_join(F.slice("classes", 1, 6), " "), F.when(F.size("classes") > 6, F.lit(" …")).otherwise(""))
    files = sets.select("signature", "classes", "file").distinct().join(groups.select(*GROUP), GROUP, "left_semi")
    listed = file_chunks(files, *GROUP).join(groups, GROUP)
    return listed.select(*GROUP, "chunk", "n_files", "n_occurrences", F.size("classes").alias("n_classes"), shown.alias("preview"), F.array_join("files", ", ").alias("files"))


def files_md5(summary: DataFrame) -> DataFrame:
    """signature, classes, files_md5 of each group: the md5 of its files joined by commas.

    The chunks of a group pass one after another through one digest in one task, which holds a batch of them at a time.
    """
    schema = "signature long, classes array<string>, files_md5 string"

    def run(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for signature, classes, files in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if digest is not None and key == (signature, classes):
                    digest.update(b", ")
                else:
                    if digest is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (signature, classes), hashlib.md5()
                digest.update(files.encode())
            yield _digests(done)
        if digest is not None:
            yield _digests([(*key, digest.hexdigest())])

    chunks = summary.select(*GROUP, "chunk", "files").repartition(*GROUP).sortWithinPartitions(*GROUP, "chunk")
    return chunks.select(*GROUP, "files").mapInArrow(run, schema)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.string()), pa.string()]
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*GROUP, "files_md5"])
