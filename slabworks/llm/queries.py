"""The registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from functools import wraps

from . import centroids, chat_format, decontaminate, exact_dedup, filter_audit, kneser_ney, language_id, license_scan, piece_codec, quality, sharding, simhash, toxicity
from .common import small_batches

_QUERIES = {
    "op6_lm_score": kneser_ney.op6_lm_score,
    "op1_quality": quality.op1_quality,
    "op8_license_scan": license_scan.op8_license_scan,
    "op10_sharding": sharding.op10_sharding,
    "op2_chat_format": chat_format.op2_chat_format,
    "op7_language_id": language_id.op7_language_id,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_simhash": simhash.op4_simhash,
    "op5_sentencepiece": piece_codec.op5_sentencepiece,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_centroids": centroids.op13_centroids,
}


def _prepared(query):
    @wraps(query)
    def run(spark, sf_dir):
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _prepared(query) for name, query in _QUERIES.items()}

SQL = {
    "op2_chat_format": chat_format.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_centroids": centroids.SQL,
}
