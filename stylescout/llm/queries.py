"""The queries of this subpackage: thin digests of the operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZER_FILE = "word_bpe_49k.json"
ALIGNED_FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    out = shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .transducer import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path()).withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import classes_linked

    return classes_linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import stored
    from .warc import read, write

    archives = stored(write(table(spark, sf_dir, "pages")))
    return read(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import compare_neighbours

    return compare_neighbours(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import link_counts

    return link_counts(table(spark, sf_dir, "documents"), *map(tokenizer_path, ALIGNED_FILES))


def op12_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiers import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import numbered_turns, prefix_trie, with_shared_heads

    return prefix_trie(with_shared_heads(numbered_turns(table(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_quality_rules, op3_token_counts, op4_ngram_jaccard, op5_bpe, op6_toxicity, op7_language_id, op8_packing, op9_warc, op10_fingerprint,
        op11_alignment, op12_tier_packing, op13_prefix_trie,
    )
}

#: Only what SQL can say; the other queries are tested against brute force, the tokenizers library or held-out labels.
SQL: dict[str, str] = {
    "op4_ngram_jaccard": r"""WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a
        FROM documents), s AS (
        SELECT DISTINCT doc_id, array_to_string(a[i:i + 4], ' ') AS g FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 3, 2))) AS i FROM w WHERE len(a) > 0)), n AS (
        SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id), p AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id), l AS (
        SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 80 * (nx.k + ny.k - o)), e AS (
        SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r(d, c) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.d = e.x)
        SELECT d AS doc_id, coalesce(any_value(k), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d""",
    "op9_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), m AS (
        SELECT *, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM m""",
}
