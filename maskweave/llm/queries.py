"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.llm import grid_codes, langid_cnn, quality_gam
from maskweave.llm.best_two_fit import pack
from maskweave.llm.circulant_minhash import near_duplicates
from maskweave.llm.common import table
from maskweave.llm.license_templates import scan_licenses
from maskweave.llm.mixing import plan_mix
from maskweave.llm.periodic_runs import run_digests
from maskweave.llm.pii_bootstrap import find_personal_data
from maskweave.llm.repair_codec import encode_and_read
from maskweave.llm.sketch import fingerprint_documents
from maskweave.llm.suffix_dedup import drop_repeats
from maskweave.llm.va_file import top_k


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents"))


def op2_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score_quality(docs, quality_gam.fit(docs, table(spark, sf_dir, "labels")))


def op5_langid_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid_cnn.identify(docs, langid_cnn.fit(docs))


def op6_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_va_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_repair_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents"))


def op11_grid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_codes.compress_vectors(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_threshold_sketch, op3_license_templates, op4_quality_gam, op5_langid_cnn, op6_pii_bootstrap, op7_circulant_minhash,
              op8_va_file_search, op9_best_two_fit, op10_repair_codec, op11_grid_codes, op12_periodic_runs, op13_suffix_dedup)
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op8_va_file_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
""",
    "op11_grid_codes": grid_codes.SQL,
}
