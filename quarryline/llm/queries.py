"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from quarryline.llm import decontamination, exact_dedup, language_id, license_scan, near_dedup, pii_surrogates, secret_scan, sentencepiece, source_audit, toxicity, url_filter, vector_codes, vector_dedup

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language_id": language_id.op3_language_id,
    "op4_pii_surrogates": pii_surrogates.op4_pii_surrogates,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_sentencepiece": sentencepiece.op9_sentencepiece,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_vector_near_dedup": vector_dedup.op12_vector_near_dedup,
    "op13_source_divergence": source_audit.op13_source_divergence,
}

ORACLE_SQL = {
    "op6_near_dedup": near_dedup.SQL,
    "op7_url_filter": url_filter.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_vector_near_dedup": vector_dedup.SQL,
    "op13_source_divergence": source_audit.SQL,
}
