"""The queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pitlane.llm import decontaminate, host_quality, html_text, licenses, near_dup, packing, sharding, suffix_dedup, token_files, url_filter

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_histogram_shards": sharding.op2_histogram_shards,
    "op3_interval_expansion": suffix_dedup.op3_interval_expansion,
    "op4_host_reputation": url_filter.op4_host_reputation,
    "op5_signature_join": near_dup.op5_signature_join,
    "op6_spaced_seeds": decontaminate.op6_spaced_seeds,
    "op7_seekable_token_files": token_files.op7_seekable_token_files,
    "op8_block_tree": html_text.op8_block_tree,
    "op9_host_rules": host_quality.op9_host_rules,
    "op10_license_bands": licenses.op10_license_bands,
}
ORACLES = {
    "op4_host_reputation": url_filter.OP4_SQL,
    "op10_license_bands": licenses.OP10_SQL,
}
