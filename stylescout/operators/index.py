"""The inverted index as flat tables, from class locations (file, class, emit_seq, line, column).

The context of a location is its line: it is read from the sources when a result is shown, and never goes through a shuffle of tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stylescout.functions.text import arbitrary_base, context_snippet, lines, placed_tokens
from stylescout.plans.shared import numbered, small, stored

LOCATION_CAP = 8
CHUNK_FILES = 1024
#: emit_seq is a line (or the number of a string in a file) times this, plus a place there: both are of 31 bits, so no two collide.
SEQ = 1 << 31


def split_lines(sources: DataFrame) -> DataFrame:
    """file, line (0-based), text of every line of every source."""
    return sources.select("file", F.posexplode(lines(F.col("source"))).alias("line", "text"))


def line_token_locations(sources: DataFrame) -> DataFrame:
    """class_locations of any text: each distinct token of each line, in order of line and place."""
    rows = split_lines(sources).select("file", "line", F.posexplode(placed_tokens(F.col("text"))).alias("pos", "token"))
    return rows.select("file", F.col("token.class").alias("class"), (F.col("line").cast("long") * SEQ + F.col("pos")).alias("emit_seq"), "line", F.col("token.column").alias("column"))


def line_contexts(sources: DataFrame) -> DataFrame:
    """file, line, context of every line."""
    return split_lines(sources).select("file", "line", context_snippet(F.col("text")).alias("context"))


def file_classes(locations: DataFrame) -> DataFrame:
    """file, class, first_seq: the distinct classes of a file in first-seen order."""
    return locations.groupBy("file", "class").agg(F.min("emit_seq").alias("first_seq"))


def cap_locations(locations: DataFrame, cap: int | None = LOCATION_CAP) -> DataFrame:
    """The first ``cap`` locations (file, class, emit_seq, line, column) of each class of a file, with loc_rank; all if cap is None.

    The limit on the rank also acts before the shuffle: a task sends ``cap`` rows of a class of a file at most.
    """
    rank = F.row_number().over(Window.partitionBy("file", "class").orderBy("emit_seq"))
    ranked = locations.select("file", "class", "emit_seq", "line", "column").withColumn("loc_rank", rank)
    return ranked if cap is None else ranked.filter(F.col("loc_rank") <= cap)


def of_terms(locations: DataFrame, terms: DataFrame) -> DataFrame:
    """``locations`` of the classes only that some term can hit: those of the terms themselves, and any with brackets, which may have a term's base.

    A class is kept or left as a whole, so ranks of locations are as in the index of all classes.
    """
    asked = small(terms.select("class", F.lit(True).alias("asked")).distinct())
    return locations.join(asked, "class", "left").filter(F.col("asked") | F.col("class").contains("[")).drop("asked")


def first_of_base(classes: DataFrame) -> DataFrame:
    """file, base, first_class: the first class of a file with each base."""
    based = classes.filter(F.col("class").contains("[")).withColumn("base", arbitrary_base(F.col("class"))).filter("base is not null")
    return based.groupBy("file", "base").agg(F.min_by("class", F.struct("first_seq", "class")).alias("first_class"))


def arbitrary_index(classes: DataFrame) -> DataFrame:
    """file, base, first_class, classes: a file's classes that share a base, in first-seen order."""
    based = classes.withColumn("base", arbitrary_base(F.col("class"))).filter("base is not null")
    ordered = F.sort_array(F.collect_list(F.struct("first_seq", "class")))
    return based.groupBy("file", "base").agg(F.min_by("class", "first_seq").alias("first_class"), F.transform(ordered, lambda x: x["class"]).alias("classes"))


def file_chunks(rows: DataFrame, *key: str) -> DataFrame:
    """``key``, chunk (from 0), files: the files of each key in order, CHUNK_FILES to a chunk, the last one shorter.

    A file's chunk comes from its place among the key's files over all ranges, whatever the partitions; no chunk is larger, and no key is one task's.
    """
    placed = numbered(rows.select(*key, "file"), list(key), [F.col("file")])
    chunk = F.floor(F.col("place") / CHUNK_FILES).alias("chunk")
    return placed.select(*key, "file", chunk).groupBy(*key, "chunk").agg(F.sort_array(F.collect_list("file")).alias("files"))


def class_postings(classes: DataFrame) -> DataFrame:
    """class, chunk, files: the nested form of the index, in chunks of bounded size; file_classes is the flat one that joins use."""
    return file_chunks(classes, "class")


def class_counts(classes: DataFrame) -> DataFrame:
    """class, n_files, first_file, last_file."""
    return classes.groupBy("class").agg(F.count("*").alias("n_files"), F.min("file").alias("first_file"), F.max("file").alias("last_file"))


def index_stats(classes: DataFrame) -> DataFrame:
    """n_files with a token at least, n_classes, n_postings."""
    return classes.agg(F.count_distinct("file").alias("n_files"), F.count_distinct("class").alias("n_classes"), F.count("*").alias("n_postings"))


@dataclass
class Index:
    """The tables a search reads."""

    sources: DataFrame
    locations: DataFrame  # capped, with loc_rank
    classes: DataFrame

    @classmethod
    def build(cls, sources: DataFrame, locations: DataFrame, cap: int | None = LOCATION_CAP) -> Index:
        return cls(sources, *_tables(cap_locations(locations, cap)))

    def saved(self) -> Index:
        """The index with its tables written once to the shared folder, as they are dealt; by file, a file's hits are added up before they are sent."""
        locations, classes = _tables(stored(self.locations))
        return Index(self.sources, locations, stored(classes))


def _tables(capped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The capped locations, and file_classes() by each class's first one."""
    return capped, capped.filter("loc_rank = 1").select("file", "class", F.col("emit_seq").alias("first_seq"))
