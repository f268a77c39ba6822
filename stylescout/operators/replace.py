"""Replacing classes in sources: edits, previews, selective application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylescout.functions.text import WS, js_trim, let
from stylescout.plans.shared import stored
from stylescout.sources.corpus import resolve, scan_sources


def replace_in_string(value: Column, targets: Column, replacements: Column) -> Column:
    """struct(new_value, changed): tokens equal to a target, whatever the case; the first becomes the replacements, others vanish."""
    low = F.transform(targets, lambda t: F.lower(t))
    parts = F.split(value, f"{WS}+")
    hit = F.transform(parts, lambda p: (p != "") & F.array_contains(low, F.lower(p)))
    first = F.array_position(hit, True)
    new = F.transform(parts, lambda p, i: F.when(~F.element_at(hit, (i + 1).cast("int")), p).when(i + 1 == first, F.array_join(replacements, " ")).otherwise(""))
    body = js_trim(F.regexp_replace(F.array_join(new, " "), f"{WS}+", " "))
    edges = let(body, lambda b: F.concat(F.when(value.rlike(f"^{WS}") & (b != ""), " ").otherwise(""), b, F.when(value.rlike(f"{WS}\\z") & (b != ""), " ").otherwise("")))
    changed = (js_trim(value) != "") & (first > 0)
    return F.struct(F.when(changed, edges).otherwise(value).alias("new_value"), F.coalesce(changed, F.lit(False)).alias("changed"))


def candidate_files(classes: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, file: files with a class equal to any target, whatever the case. requests: request_id, targets, replacements."""
    wanted = requests.select("request_id", F.explode(F.transform("targets", lambda t: F.lower(t))).alias("low")).distinct()
    return classes.select("file", F.lower("class").alias("low")).join(wanted, "low").select("request_id", "file").distinct()


def compute_edits(sources: DataFrame, requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """request_id, file, line, start, end, before, new_text: the edits of each request in its candidate files, each start once."""
    files = sources.join(candidates.select("file").distinct(), "file", "left_semi")
    leaves = resolve(stored(scan_sources(files)), editing=True)
    # an expression inside another one is met twice, and so is a variable that is used twice
    spans = leaves.groupBy("file", "start").agg(F.min(F.struct("seq", "kind", "value", "end", "line", "raw")).alias("s")).select("file", "start", "s.*")
    met = spans.join(candidates, "file").join(requests, "request_id")
    made = met.withColumn("r", replace_in_string(F.col("value"), F.col("targets"), F.col("replacements"))).filter("r.changed")
    # an identifier is replaced as a whole, without quotes
    quoted = F.concat(F.substring("raw", 1, 1), F.col("r.new_value"), F.right("raw", F.lit(1)))
    text = F.when(F.col("kind") == "key", F.array_join("replacements", " ")).when(F.col("kind") == "quasi", F.col("r.new_value")).otherwise(quoted)
    return made.select("request_id", "file", "line", "start", "end", F.col("raw").alias("before"), text.alias("new_text"))


def preview_replacements(edits: DataFrame) -> DataFrame:
    """Edits with a key that names file, place and old text, so that it is gone when they change."""
    key = F.sha2(F.concat_ws("\x01", F.col("request_id").cast("string"), "file", F.col("start").cast("string"), "before"), 256)
    return edits.select(key.alias("key"), "request_id", "file", "line", "before", F.col("new_text").alias("after"), "start", "end", "new_text")


def apply_selected(preview: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edits of the current preview whose key is selected, and one row with how many selected keys are gone."""
    keys = selected.select("key").distinct()
    return preview.join(keys, "key", "left_semi"), keys.join(preview.select("key"), "key", "left_anti").agg(F.count("*").alias("skipped"))


def apply_edits(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """file, source with the file's edits made, from the last to the first; files without edits are left out."""
    order = F.sort_array(F.collect_list(F.struct("start", "end", "new_text")), asc=False)
    listed = edits.groupBy("file").agg(order.alias("edits"))
    step = lambda s, e: F.concat(F.substring(s, F.lit(1), e["start"]), e["new_text"], F.substr(s, e["end"] + 1))
    return sources.select("file", "source").join(listed, "file").select("file", F.aggregate("edits", F.col("source"), step).alias("source"))


def replace_summary(edits: DataFrame) -> DataFrame:
    """request_id, n_files, n_occurrences."""
    return edits.groupBy("request_id").agg(F.count_distinct("file").alias("n_files"), F.count("*").alias("n_occurrences"))
