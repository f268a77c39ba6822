"""The registered queries of the corpus operators on the small tables: against their SQL, or run whole with their contract's columns."""

import hashlib
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stylescout.llm.queries import QUERIES, SQL


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    # a column of whole numbers with nulls comes as floats from one side
    text = lambda v: "NULL" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) and not v.is_integer() else str(int(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, data, name):
    with duckdb.connect() as con:
        for t in ("documents", "pages"):
            con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
        want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_whole_tables(spark, data):
    """op1, op2, op6 and op10 as registered: a row for each document, with the values that follow from the texts alone."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for name in ("op1_sharding", "op2_quality_rules", "op6_toxicity", "op10_fingerprint"):
        rows = {r["doc_id"]: r for r in QUERIES[name](spark, data).collect()}
        assert rows.keys() == docs.keys()
        for i, r in rows.items():
            if name == "op1_sharding":
                raw = docs[i].encode()
                assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= r["shard"] < 16
            elif name == "op2_quality_rules":
                words = docs[i].split()
                assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words)) and not (r["kept"] and r["base_failed"])
            elif name == "op6_toxicity":
                assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
            else:
                following = docs[max((k for k in docs if k < i), default=max(docs))]
                n = len(docs[i]) // 3
                edited = docs[i][: len(docs[i]) - n] + following[:n]
                assert r["n_chars"] == len(docs[i]) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_pipeline_of_odd_tables(spark, data, tmp_path):
    """Empty tables, nulls, repeated ids, very long texts and columns with clashing names go through all four stages."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(30)
    plain = docs.first()["text"]
    long = " ".join(f"word{i % 997} and then{i % 1009}" for i in range(60_000))
    odd = [(900, plain), (900, plain), (None, None), (None, plain), (901, ""), (902, long), (900, long + " more")]
    more = docs.limit(0).unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    for k, rows in enumerate((docs.unionByName(more), docs.limit(0))):
        folder = str(tmp_path / str(k))
        for name in ("length", "row", "part", "item", "piece", "toxicity", "class", "sequence_id", "kept", "a.b", "c`d"):
            rows = rows.withColumn(name, F.lit("clash"))
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
        got = out.collect()
        assert (len(got) > 0) == (k == 0)
    assert sum(r["doc_id"] == 901 for r in got) == 0
