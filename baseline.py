"""What the jobs are measured against: the same results by visiting every file, line or source, on $BENCH_SF_DIR; prints one JSON line.

"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylescout.operators import index as I
from stylescout.operators import search as S
from stylescout.plans import catalog
from stylescout.plans import inputs as In
from stylescout.plans.shared import drop_stored, durable, stored
from stylescout.sources import corpus as C


def scores_by_all_files(routed: DataFrame, classes: DataFrame) -> DataFrame:
    """Every query against every file's set of classes (exact hits; the documents have no near ones)."""
    files = classes.groupBy("file").agg(F.collect_set("class").alias("classes"))
    met = files.crossJoin(F.broadcast(routed.select("query_id", "terms", "n_terms")))
    met = met.withColumn("score", F.size(F.array_intersect("terms", "classes")) / F.col("n_terms"))
    return met.filter(F.col("score") >= S.MIN_SCORE).select("query_id", "file", F.round("score", 6).alias("score"))


def phrases_by_all_lines(routed: DataFrame, lines: DataFrame) -> DataFrame:
    """Every phrase against every line."""
    asked = routed.filter("search_text is not null").select("query_id", F.lower("search_text").alias("phrase")).filter(~F.col("phrase").rlike("\n"))
    met = lines.withColumn("low", F.lower("text")).join(F.broadcast(asked), F.col("low").contains(F.col("phrase")))
    return met.select("query_id", "file").distinct()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    index = In.document_index(spark, sf_dir).saved()
    routed = durable(S.route_queries(In.benchmark_queries(spark, sf_dir)))
    terms, lines = durable(S.query_terms(routed)), I.split_lines(index.sources)
    old, now = catalog._listings(spark, sf_dir)
    path = f"{stored(spark.range(1)).inputFiles()[0]}-index"
    C.save_index(C.extract_classes(old), old, path)

    def rebuilt():
        C.save_index(C.extract_classes(now), now, path + "-new")
        return C.load_index(spark, path + "-new").select("file", "class")

    def refreshed():
        C.refresh_index(spark, path, now)
        return C.load_index(spark, path).select("file", "class")

    words = stored(S.line_words(lines))  # part of the index
    pairs = {
        "score_files (minimum 0.3)": (
            lambda: scores_by_all_files(routed, index.classes),
            lambda: S.score_files(routed, terms, index.classes, S.MIN_SCORE).select("query_id", "file", F.round("score", 6).alias("score")),
        ),
        "phrase_search": (lambda: phrases_by_all_lines(catalog._line_queries(spark, sf_dir), lines), lambda: S.phrase_hits(catalog._line_queries(spark, sf_dir), lines, words).select("query_id", "file").distinct()),
        "refresh (against a rebuild)": (rebuilt, refreshed),
    }
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name, both in pairs.items():
        took, rows = [], []
        for job in both:
            began = time.time()
            rows.append(sorted(map(tuple, job().collect())))
            took.append(round(time.time() - began, 3))
        assert rows[0] == rows[1], name
        seconds[name] = {"all": took[0], "job": took[1], "rows": len(rows[0])}
    drop_stored(spark)
    print(json.dumps({"metric": "against visiting everything", "unit": "sec", "pairs": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
