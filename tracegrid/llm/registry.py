"""The queries of the training-data operators and of their pipeline."""

from __future__ import annotations

from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, kneser_ney, license_scan, mixing, mpeg_audio, near_dedup, oracle, pii, quality_rules, ranked_search, token_output, url_filters, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {
        "op1_token_output": token_output.op1_token_output,
        "op2_url_filters": url_filters.op2_url_filters,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op9_quality_classifier": kneser_ney.op9_quality_classifier,
        "op6_license_scan": license_scan.op6_license_scan,
        "op5_mixing": mixing.op5_mixing,
        "op3_warc": warc.op3_warc,
        "op7_mpeg_audio": mpeg_audio.op7_mpeg_audio,
        "op8_byte_bpe": byte_bpe.op8_byte_bpe,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_pii": pii.op11_pii,
        "op12_whitening": whitening.op12_whitening,
        "op13_ranked_search": ranked_search.op13_ranked_search,
    }
    if find_spec("corpus_pipeline"):
        import corpus_pipeline

        out["pipeline"] = corpus_pipeline.run
    return out


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
