"""Sources: scanning files, extracting class locations, saving, loading and refreshing an index."""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stylescout.functions import text as T
from stylescout.functions.scanner import places, scan
from stylescout.operators.index import LOCATION_CAP, SEQ
from stylescout.plans.shared import durable, stored
from stylescout.sources.snapshot import MOST_DELTAS, commit, compact, create_snapshot, log, manifest, read_snapshot

#: Files of a corpus, and directories that are left out at any depth below its root (fixed values).
INCLUDE = "**/*.{ts,tsx,js,jsx}"
EXCLUDE = ("node_modules", ".next", "dist", "build", "coverage", ".git", "out")


def glob_regex(glob: str) -> str:
    """A glob with ``**``, ``*``, ``?`` and braces as a regular expression for whole paths."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|" if "{" in glob[:i] and "}" in glob[i:] else ","}.get(c, re.escape(c))
            i += 1
    return f"^{out}$"


def excluded(path, exclude: tuple[str, ...] = EXCLUDE):
    """Whether a path, taken from the corpus root on, lies in one of the directories."""
    return path.rlike("(?:^|/)(?:" + "|".join(map(re.escape, exclude)) + ")/") if exclude else F.lit(False)


def scan_corpus(spark: SparkSession, path: str, include: str = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """sources (file, source, mtime_ms): the files under ``path`` that the include glob takes and no excluded directory below ``path`` holds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", path).rstrip("/")
    inside = F.regexp_replace("path", "^.*?" + re.escape(root) + "/+", "")
    kept = files.filter(inside.rlike(glob_regex(include)) & ~excluded(inside, exclude))
    return kept.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("source"), F.unix_millis("modificationTime").alias("mtime_ms"))


LEAVES = (
    "file string, root int, pos int, role string, owner string, nested boolean, in_value boolean, kind string, value string, key string, "
    "start int, end int, line int, column int, context string, raw string, parse_error string"
)
#: rows of an output batch of the scan
SCAN_ROWS = 10_000


def scan_sources(sources: DataFrame) -> DataFrame:
    """The leaves (``LEAVES``) of each source's class and style expressions, or one row with parse_error for a source that can't be read."""
    names = [f.split()[0] for f in LEAVES.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]] for f in LEAVES.split(", ")]

    def rows_of(file: str, source: str):
        try:
            leaves = scan(source)
            where = places(source, leaves)
        except Exception as e:  # whatever a source does to the reader is an error of that source
            yield (file, *[None] * (len(names) - 2), str(e) or type(e).__name__)
            return
        for i, (x, at) in enumerate(zip(leaves, where, strict=True)):
            yield (file, x.root, i, x.role, x.owner, x.nested, x.in_value, x.kind, x.value, x.key, x.start, x.end, *at, source[x.start : x.end] if x.kind in ("string", "quasi", "key") else None, None)

    def run(batches):
        for batch in batches:
            made = itertools.chain.from_iterable(rows_of(f, s or "") for f, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            while rows := list(itertools.islice(made, SCAN_ROWS)):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), kinds)), names)

    return sources.select("file", "source").mapInArrow(run, LEAVES)


def expansions(items: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """What names stand for, from the items of their initialisers: (file, role, name, at, pos, use), a leaf's pos or a used name, in the order of ``at``.

    First, names that lead to leaves only, with all their leaves: each round puts a used name's own list in its place, so lists reach twice as
    deep, and keeps the first ``limit`` times that a list holds one leaf or one name; what it drops can't be among the first ``limit`` of any
    leaf, as every use of a name holds the same. Second, names that lead back to a name on the way (no round ends them): file, role, name.
    """
    list_of = ["file", "role", "name"]
    now = durable(items)
    most = now.groupBy("file").agg(F.count_distinct("name").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(most.bit_length() + 1):
        uses = now.filter("use is not null")
        if uses.isEmpty():
            break
        inner = now.select("file", "role", F.col("name").alias("use"), F.col("at").alias("inner_at"), "pos", F.col("use").alias("inner_use"))
        deeper = uses.drop("pos").join(inner, ["file", "role", "use"]).select(*list_of, F.struct("at", "inner_at").alias("at"), "pos", F.col("inner_use").alias("use"))
        both = now.filter("use is null").select(*list_of, F.struct("at", F.lit(0).cast("long").alias("inner_at")).alias("at"), "pos", "use").unionByName(deeper)
        place = F.row_number().over(Window.partitionBy(*list_of).orderBy("at")).cast("long")
        times = F.row_number().over(Window.partitionBy(*list_of, "pos", "use").orderBy("at"))
        now = durable(both.withColumn("times", times).filter(F.col("times") <= limit).withColumn("at", place).drop("times"))
    looping = now.filter("use is not null").select(*list_of).distinct()
    return now.join(looping, list_of, "left_anti").select(*list_of, "at", "pos"), looping


def resolve(leaves: DataFrame, editing: bool = False, limit: int = LOCATION_CAP) -> DataFrame:
    """The strings, keys and styles that the class and style expressions of stored ``leaves`` come to, with seq, their order in the file.

    An identifier stands for what its name was last initialised with in the file, whatever the scope; one that leads back to itself ends. Of one
    expression, the first ``limit`` times that it comes to a leaf count. Extraction (for an index) takes expressions that lie in no other
    one, and keys of objects only; editing takes all class expressions, and objects' values too.
    """
    counted = leaves.filter("parse_error is null").filter("role = 'class'" if editing else "not nested and not in_value")
    declared = leaves.filter("kind = 'declared'").groupBy("file", F.col("owner").alias("name")).agg(F.max("root").alias("last"))
    columns = ["file", "role", "kind", "value", "key", "start", "end", "line", "column", "context", "raw"]
    use = F.when(F.col("kind") == "use", F.col("value")).alias("use")
    pos = F.col("pos").cast("long").alias("pos")
    inits = counted.filter("owner is not null and kind <> 'declared'").select("file", "role", F.col("owner").alias("name"), "root", pos, use)
    items = inits.join(declared, ["file", "name"]).filter("root = last").select("file", "role", "name", F.col("pos").alias("at"), F.when(F.col("use").isNull(), F.col("pos")).alias("pos"), "use")
    direct = counted.filter("owner is null and kind <> 'use'").select(*columns, F.array(pos).alias("path"))
    # uses: file, role, root, path (places down to it), name, seen (names on the way that lead back to one)
    uses = stored(counted.filter("owner is null and kind = 'use'").select("file", "role", "root", F.array(pos).alias("path"), F.col("value").alias("name"), F.array().cast("array<string>").alias("seen")))
    if uses.isEmpty():
        return direct.select(*columns, (F.row_number().over(Window.partitionBy("file").orderBy("path")) - 1).alias("seq"))
    items = stored(items)
    lists, looping = expansions(items, limit)
    lists, loops = stored(lists), stored(items.join(looping, ["file", "role", "name"], "left_semi"))
    known = ["file", "role", "name"]
    found = uses.join(lists, known).select("file", "root", F.concat("path", F.array("at")).alias("path"), "pos")
    while not loops.isEmpty():
        # one name at a time, on each way without a repeated name; ways through the same names are the same from there on
        step = uses.filter(~F.array_contains("seen", F.col("name"))).join(loops, known)
        step = step.select("file", "role", "root", F.concat("path", F.array("at")).alias("path"), "pos", "use", F.array_sort(F.concat("seen", F.array("name"))).alias("seen"))
        times = F.row_number().over(Window.partitionBy("file", "role", "root", "pos", "use", "seen").orderBy("path"))
        step = durable(step.withColumn("times", times).filter(F.col("times") <= limit))
        uses = step.filter("use is not null").select("file", "role", "root", "path", F.col("use").alias("name"), "seen")
        found = found.unionByName(step.filter("use is null").select("file", "root", "path", "pos"))
        found = found.unionByName(uses.join(lists, known).select("file", "root", F.concat("path", F.array("at")).alias("path"), "pos"))
        if uses.isEmpty():
            break
    times = F.row_number().over(Window.partitionBy("file", "root", "pos").orderBy("path"))
    found = found.withColumn("times", times).filter(F.col("times") <= limit).select("file", F.col("path"), "pos")
    met = found.join(leaves.withColumn("pos", pos), ["file", "pos"]).select(*columns, "path")
    return direct.unionByName(met).select(*columns, (F.row_number().over(Window.partitionBy("file").orderBy("path")) - 1).alias("seq"))


def locations_of(resolved: DataFrame) -> DataFrame:
    """class_locations of resolve(): the cleaned tokens of class strings, and style tokens, in order."""
    value = T.normalize_style_value(F.col("value"))
    style = F.when(value != "", F.array(F.concat(F.lit("style:"), T.normalize_style_key(F.col("key")), F.lit(":"), value))).otherwise(F.array().cast("array<string>"))
    tokens = F.when(F.col("kind") == "style", style).otherwise(T.tokenize(F.col("value")))
    rows = resolved.select("file", "seq", "line", "column", "context", F.posexplode(tokens).alias("pos", "class"))
    return rows.select("file", "class", (F.col("seq").cast("long") * SEQ + F.col("pos")).alias("emit_seq"), "line", "column", "context")


def errors_of(leaves: DataFrame) -> DataFrame:
    """file, parse_error of the sources that can't be read."""
    return leaves.filter("parse_error is not null").select("file", "parse_error")


def extract(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """class_locations and errors of the sources, read once."""
    leaves = stored(scan_sources(sources))
    return locations_of(resolve(leaves)), errors_of(leaves)


def extract_classes(sources: DataFrame) -> DataFrame:
    return extract(sources)[0]


def extract_errors(sources: DataFrame) -> DataFrame:
    return errors_of(scan_sources(sources))


def save_index(locations: DataFrame, sources: DataFrame, path: str, include: str = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> None:
    """A new snapshot of the locations with their file's mtime."""
    create_snapshot(locations.sparkSession, path, include, exclude)
    stamped = locations.join(sources.select("file", "mtime_ms"), "file").withColumn("deleted", F.lit(False))
    if "context" not in stamped.columns:
        stamped = stamped.withColumn("context", F.lit(None).cast("string"))
    commit(stamped, path, 0, base=True)


def load_index(spark: SparkSession, path: str, include: str = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame | None:
    """The snapshot's locations with mtime_ms, or None if it was made with other globs."""
    made = manifest(spark, path)
    if (made["include"], made["exclude"]) != (include, ",".join(exclude)):
        return None
    return read_snapshot(spark, path).filter("class is not null").drop("deleted")


def refresh_status(snapshot: DataFrame, scanned: DataFrame) -> DataFrame:
    """file, status: unchanged, extract (new or newer) or removed, of files (file, mtime_ms) before and now."""
    old = snapshot.groupBy("file").agg(F.max("mtime_ms").alias("old_ms"))
    now = scanned.select("file", F.col("mtime_ms").alias("new_ms"))
    status = F.when(F.col("new_ms").isNull(), "removed").when(F.col("old_ms") >= F.col("new_ms"), "unchanged").otherwise("extract")
    return old.join(now, "file", "full_outer").select("file", status.alias("status"))


def refresh(snapshot: DataFrame, scanned: DataFrame) -> DataFrame:
    """The locations (with mtime_ms) after a scan: kept for unchanged files, extracted anew for new or newer ones, dropped for others."""
    status = refresh_status(snapshot, scanned)
    kept = snapshot.join(status.filter("status = 'unchanged'").select("file"), "file", "left_semi")
    todo = scanned.join(status.filter("status = 'extract'").select("file"), "file", "left_semi")
    fresh = extract_classes(todo).join(todo.select("file", "mtime_ms"), "file")
    return kept.unionByName(fresh)


def marked_rows(locations: DataFrame, files: DataFrame) -> DataFrame:
    """Snapshot rows of ``files`` (file, mtime_ms, deleted): their locations, or a mark where a file has none."""
    found = stored(locations.join(files.filter("not deleted").select("file", "mtime_ms"), "file").withColumn("deleted", F.lit(False)))
    bare = files.select("file", "mtime_ms", "deleted").join(found.select("file").distinct(), "file", "left_anti")
    return found.unionByName(bare, allowMissingColumns=True)


def refresh_index(spark: SparkSession, path: str, scanned: DataFrame) -> None:
    """The snapshot at ``path`` brought up to date with a scan: new and newer files are extracted, and they and those that are gone are committed
    as a delta. Nothing is written of the others; nothing at all where no file has changed. Conflict if another writer was first.
    """
    entries = log(spark, path)
    known = read_snapshot(spark, path, entries).filter("not deleted").groupBy("file").agg(F.max("mtime_ms").alias("mtime_ms"))
    status = stored(refresh_status(known, scanned).filter("status <> 'unchanged'"))
    todo = scanned.join(status.filter("status = 'extract'").select("file"), "file", "left_semi").select("file", "source", "mtime_ms")
    gone = known.join(status.filter("status = 'removed'").select("file"), "file", "left_semi")
    if status.isEmpty():
        return
    todo = stored(todo)
    touched = todo.select("file", "mtime_ms", F.lit(False).alias("deleted")).unionByName(gone.withColumn("deleted", F.lit(True)))
    commit(marked_rows(extract_classes(todo), touched), path, entries[-1]["version"])
    compact(spark, path, MOST_DELTAS)
