"""Queries of the training-data operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import corpus_pipeline
from weirflow.llm import ann, lm_score, packing, pii, quality_model, quality_rules, sharding, simhash, tokenize, warc

QUERIES = {
    "op1_byte_bpe": tokenize.op1_byte_bpe,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_adaptive_scan": ann.op3_adaptive_scan,
    "op4_warc_zstd": warc.op4_warc_zstd,
    "op5_simhash": simhash.op5_simhash,
    "op6_ring_sharding": sharding.op6_ring_sharding,
    "op7_pii_segments": pii.op7_pii_segments,
    "op8_quality_classifier": quality_model.op8_quality_classifier,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_cross_entropy_difference": lm_score.op10_cross_entropy_difference,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op4_warc_zstd": warc.OP4_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
