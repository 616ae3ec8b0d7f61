"""Queries of the training-data operators, with the parameters they run with in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontaminate, divergence, lines, quality, secrets, sharding, simhash, suffixes, tokenfile, variants

SHARDS = 16
QUALITY_AT = 0.3


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, what strings of 50 bytes repeat from documents of smaller ids (``suffixes.remove_repeats``)."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), 50)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document over 16 shards by rendezvous hashing of doc_id; the law is key (``sharding``)."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a fifth of the labels is held out (``quality``). Rows of a null id are never held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model, QUALITY_AT)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100 (``ann.nearest``)."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (``simhash.simhash_classes``)."""
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best alignment of every document and benchmark item that overlap (``decontaminate.find_overlaps``)."""
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of every document's ids and of the text decoded from them (``bpe.encode_documents``)."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, the lines and spans cut as repeated, and a digest of what is left (``lines.dedup_runs``)."""
    out = lines.dedup_runs(table(spark, sf_dir, "documents"), report=True)
    return out.select("doc_id", "n_lines_removed", "n_chunks_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, as read back from token files (``tokenfile``)."""
    return tokenfile.tokenize_to_files(table(spark, sf_dir, "documents"), vocabulary())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document and how widely its values are owned; a document stands for a repository, its source
    for the owner (``secrets.scan_secrets``)."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


#: What both turns of the conversation say that op11 adds: an escape character, a role marker and an end of turn.
PROBE = "\\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, trainable replies and size of every conversation, as read back from its examples (``chat``); conversation -7 is
    added, also to an empty table."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    return chat.read_back(chat.expand(rows.unionByName(probe)), arranged=True)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of every language lie apart, and the terms that set each apart (``divergence``)."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every frequent word of six letters or more (``variants``)."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_sharding": op2_sharding,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_nearest": op4_nearest,
        "op5_simhash": op5_simhash,
        "op6_decontamination": op6_decontamination,
        "op7_bpe": op7_bpe,
        "op8_line_dedup": op8_line_dedup,
        "op9_token_files": op9_token_files,
        "op10_secret_scan": op10_secret_scan,
        "op11_chat_format": op11_chat_format,
        "op12_source_divergence": op12_source_divergence,
        "op13_spelling_variants": op13_spelling_variants,
    }


CHAT_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
  s AS (SELECT *, length(url_encode(role)) + 16 + length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '<turn', '<\turn')) AS chars, row_number() OVER w AS place, lead(1) OVER w IS NULL AS final
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
  c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR final) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

DIVERGENCE_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
  kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) x GROUP BY lang, term HAVING count(*) >= 10),
  v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
  n AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) x JOIN kept USING (lang, term) GROUP BY lang, source, term),
  g AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN n USING (lang, source) GROUP BY g.lang, g.source),
  q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 2)) // (t.total + 2 * v.v) AS q FROM n JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) t USING (lang) GROUP BY lang, term, t.total, v.v),
  p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n.n, 0) + 2)) // (g.total + 2 * v.v) AS p FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
  f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
  r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) x WHERE part = 'pair' OR rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; crc32, which op13 needs, it can't."""
    return {"op11_chat_format": CHAT_SQL, "op12_source_divergence": DIVERGENCE_SQL}
