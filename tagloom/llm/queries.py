"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, exact_dedup, filter_audit, hard_negatives, language_id, license_scan, line_dedup, lm_scoring, minhash, packing, repeats, token_counts, toxicity

QUERIES = {
    "op1_near_dedup": minhash.op1_near_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_repeats": repeats.op3_repeats,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_packing": packing.op6_packing,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_lm_scoring": lm_scoring.op8_lm_scoring,
    "op9_language_id": language_id.op9_language_id,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {**minhash.ORACLE, **exact_dedup.ORACLE, **license_scan.ORACLE, **filter_audit.ORACLE, **hard_negatives.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
