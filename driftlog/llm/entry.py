"""The registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from .binary_output import encode_to_files
from .common import documents
from .decontamination import contaminated
from .fingerprints import fingerprint
from .licenses import scan
from .near_duplicates import near_duplicates
from .packing import pack
from .ppm import ppm_scores
from .quality import quality
from .repeats import repeated_passages
from .toxicity import toxicity


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_ppm_scores(spark, sf_dir):
    return ppm_scores(documents(spark, sf_dir))


def op2_quality_embeddings(spark, sf_dir):
    return quality(documents(spark, sf_dir), _labels(spark, sf_dir))


def op3_best_fit_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))


def op5_token_binary(spark, sf_dir):
    return encode_to_files(documents(spark, sf_dir))


def op6_toxicity_grammar(spark, sf_dir):
    return toxicity(documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_winnowing(spark, sf_dir):
    return fingerprint(documents(spark, sf_dir))


def op9_benchmark_decontamination(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("th")


def op10_license_scan(spark, sf_dir):
    return scan(documents(spark, sf_dir))


def op4_bagminhash_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id")


def op8_suffix_array_dedup(spark, sf_dir):
    return repeated_passages(documents(spark, sf_dir))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
