"""A corpus pipeline: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. The first
three return the columns of documents; the last returns the pieces of the packed sequences. Once a stage's output is written,
the intermediate tables that it noted are deleted.

In every stage nulls, empty texts and repeated rows are documents like others; an empty table gives an empty one, and extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stylescout.llm import jaccard, packing, quality, toxicity
from stylescout.llm.common import drop, noting, stored, table
from stylescout.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learnt decision list keep.

    A null or empty text has no words, so the base rules reject it. Each of several equal rows is judged alike; rules are tried in their
    order, so there are no ties.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    A null or empty text has the score of no features; equal texts have equal scores, and go or stay together; a score of just 0.3 goes.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Documents without words, null texts too, are linked with nothing: they all stay. Of rows equal in id and words, the first by text stays.
    """
    return jaccard.keep_first(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens.

    A null or empty text is one piece of its closing id; repeated rows are packed as often as they occur; equal lengths go by the pieces' own numbers.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        behind: list[str] = []
        with noting(behind):
            kept = stored(stage(spark, docs, sf_dir), keep=True)
        drop(spark, behind)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learnt stages can't be said in SQL.
ORACLE_SQL = None
