"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerwork.llm.ann import nearest_neighbours
from wickerwork.llm.bpe import bpe_encode
from wickerwork.llm.collocations import COLLOCATION_SQL, mine_collocations
from wickerwork.llm.exact_dedup import exact_dedup
from wickerwork.llm.filter_audit import AUDIT_SQL, audit_filters
from wickerwork.llm.hmm_lm import score_documents
from wickerwork.llm.line_dedup import dedup_lines
from wickerwork.llm.mixing import mix_sources
from wickerwork.llm.near_dedup import near_duplicates
from wickerwork.llm.secret_scan import scan_secrets
from wickerwork.llm.sharding import shard_by_size
from wickerwork.llm.toxicity import fit_toxicity, held_out
from wickerwork.llm.warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By shares of 400 slots, as its SQL has it; for more than 400 sources of four slots a source, of which the SQL knows nothing."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    sources = docs.select(F.coalesce("source", F.lit(""))).distinct().count()
    return mix_sources(docs, period=400 if sources <= 400 else 4 * sources).drop("mix_source")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_size(_table(spark, sf_dir, "documents"), 8)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50, line_words=4)
    return cut.select("doc_id", "words_cut", "bytes_cut", F.octet_length("text").alias("bytes_left"), F.sha2("text", 256).alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return model.score(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_table(spark, sf_dir, "documents"), vocabulary(), with_ids=False, digests=True)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)


def op10_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(_table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_near_dedup": op2_near_dedup,
    "op3_sharding": op3_sharding,
    "op4_ann": op4_ann,
    "op5_line_dedup": op5_line_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_warc": op9_warc,
    "op10_hmm_lm": op10_hmm_lm,
    "op11_filter_audit": op11_filter_audit,
    "op12_collocations": op12_collocations,
    "op13_secret_scan": op13_secret_scan,
}

SQL = {
    "op11_filter_audit": AUDIT_SQL,
    "op12_collocations": COLLOCATION_SQL,
    "op1_mixing": """
WITH RECURSIVE src AS (
  SELECT coalesce(source, '') AS s, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY 1),
exact AS (
  SELECT s, n, round((400 - count(*) OVER ()) * w / sum(w) OVER (), 9) AS x, count(*) OVER () AS k FROM src),
dealt AS (
  SELECT s, n, 1 + floor(x)::BIGINT
    + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, s) <= 400 - k - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS e
  FROM exact),
lists AS (SELECT list(e ORDER BY s) AS es, list(n ORDER BY s) AS ns, list(s ORDER BY s) AS ss FROM dealt),
edf AS (
  SELECT 0 AS t, list_transform(es, lambda e: 0::BIGINT) AS done, 0::BIGINT AS pick, es FROM lists
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(es) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p, es
  FROM (
    SELECT t, done, es, list_min(list_transform(
      list_filter(range(1, len(es) + 1), lambda i: done[i] < es[i] AND done[i] * 400 // es[i] <= t),
      lambda i: ((done[i] + 1) * 400 + es[i] - 1) // es[i] * 100000 + i)) % 100000 AS p
    FROM edf WHERE t < 400)),
slots AS (
  SELECT p.t - 1 AS slot, ss[p.pick] AS s, list_transform(range(1, len(p.es) + 1), lambda i: p.done[i] - CASE WHEN i = p.pick THEN 1 ELSE 0 END) AS before,
    row_number() OVER (PARTITION BY p.pick ORDER BY p.t) - 1 AS nth, p.es, ns
  FROM edf p, lists WHERE p.t > 0),
ranked AS (
  SELECT doc_id, source, coalesce(source, '') AS s,
    row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY ('0x' || substr(h, 1, 6))::BIGINT % 1024, h, doc_id) - 1 AS r
  FROM (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents)),
blocks AS (SELECT r.*, r // 16 AS b, d.e FROM ranked r JOIN dealt d USING (s))
SELECT b.doc_id, b.source, b.b AS mix_block, b.b // b.e * 400 + sl.slot AS mix_slot,
  b.b * 400 // b.e AS mix_release, ((b.b + 1) * 400 + b.e - 1) // b.e AS mix_deadline,
  (list_sum(list_transform(range(1, len(sl.es) + 1), lambda i: least(sl.ns[i], 16 * (b.b // b.e * sl.es[i] + sl.before[i]))))
    + b.r % 16)::BIGINT AS mix_position
FROM blocks b JOIN slots sl ON sl.s = b.s AND sl.nth = b.b % b.e
""",
    "op9_warc": """
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(sha1(t), 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type, nullif(origin, page_id) AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS t, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS origin FROM pages)
""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
""",
}
