"""Ranks over ranges, postings in chunks, and the cap on locations."""

import random

import pytest
from pyspark.sql import functions as F

from stylescout.operators import index as I
from stylescout.plans.shared import numbered, stored


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_numbered(spark, partitions):
    """Places are those of a sort of each key, whatever the ranges; half of all rows have one key, ties and nulls too."""
    rng = random.Random(partitions)
    rows = [(rng.choice((0, 0, 0, 0, 1, 2, None, 9)), rng.randrange(40), f"v{i}") for i in range(1500)]
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = spark.createDataFrame(rows, "k int, o int, v string").repartition(5)
        got = [tuple(r) for r in numbered(df, ["k"], [F.col("o"), F.col("v")]).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", conf)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for k in {r[0] for r in rows}:
        want += [(*r, i) for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert numbered(df.limit(0), ["k"], [F.col("o")]).count() == 0


def test_postings_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(I, "CHUNK_FILES", 7)
    rows = [(f"f{i:03}", c) for i in range(100) for c in ("hot", f"c{i % 3}")]
    files = lambda c: sorted(f for f, x in rows if x == c)
    want = sorted((c, k // 7, tuple(files(c)[k : k + 7])) for c in ("hot", "c0", "c1", "c2") for k in range(0, len(files(c)), 7))
    for partitions in (1, 9):
        posted = I.class_postings(spark.createDataFrame(rows, "file string, class string").repartition(partitions))
        assert sorted((r["class"], r["chunk"], tuple(r["files"])) for r in posted.collect()) == want


def test_cap_acts_before_the_shuffle(spark):
    """A task sends eight rows of a class of a file, however often it stands there."""
    source = "\n".join("a b" for _ in range(500))
    lines = stored(spark.createDataFrame([("f", source)], "file string, source string").repartition(1))
    places = I.line_token_locations(lines)
    plan = I.cap_locations(places)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Partial") > plan.index("Exchange")  # below it, nearer to the scan
    got = I.cap_locations(places).groupBy("class").agg(F.count("*").alias("n"), F.max("line").alias("last")).collect()
    assert sorted(map(tuple, got)) == [("a", 8, 7), ("b", 8, 7)]


def test_long_line_keeps_its_order(spark):
    """Places behind the millionth of a line come before the next line."""
    source = " ".join(f"t{i}" for i in range(1_000_001)) + "\nt1000000 z"
    places = I.line_token_locations(spark.createDataFrame([("f", source)], "file string, source string"))
    got = I.cap_locations(places.filter("class in ('t1000000', 'z', 't0')")).orderBy("emit_seq").select("class", "line").collect()
    assert [tuple(r) for r in got] == [("t0", 0), ("t1000000", 0), ("t1000000", 1), ("z", 1)]
