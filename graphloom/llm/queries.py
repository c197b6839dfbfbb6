"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, hpyp, licenses, media_ts, packing, quality, simhash, suffix_dedup, topk, toxicity
from .common import held_out, read_table


def tokenizer_path() -> str:
    """Where the published vocabulary lies; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_topk(spark, sf_dir):
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op2_transport_stream(spark, sf_dir):
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return media_ts.read(media_ts.store(read_table(spark, sf_dir, "documents")), payload=False).select(columns)


def op3_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.mark_repeats(read_table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit_on(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", "predicted")


def op8_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", "predicted")


def op9_bpe(spark, sf_dir):
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_hpyp(spark, sf_dir):
    return hpyp.score_documents(read_table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_topk, op2_transport_stream, op3_packing, op4_suffix_dedup, op5_license_scan, op6_simhash, op7_quality, op8_toxicity, op9_bpe, op10_hpyp)}


TOP_K_SQL = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def oracle_sql():
    return {"op1_topk": TOP_K_SQL, "op5_license_scan": licenses.oracle_sql()}
