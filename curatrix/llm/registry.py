"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from curatrix.llm import audit, decontaminate, extraction, fingerprint, licenses, lines, mixing, periodic, simhash, substrings, suffixes, tokens, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_line_dedup": lines.query,
    "op3_html_extraction": extraction.query,
    "op4_source_mixing": mixing.query,
    "op5_benchmark_decontamination": decontaminate.query,
    "op6_document_fingerprints": fingerprint.query,
    "op7_simhash_near_dedup": simhash.query,
    "op8_substring_dedup": substrings.query,
    "op9_suffix_array_dedup": suffixes.query,
    "op10_token_id_output": tokens.query,
    "op11_filter_audit": audit.query,
    "op12_license_scan": licenses.query,
    "op13_periodic_runs": periodic.query,
}

SQL = {
    "op4_source_mixing": mixing.SQL,
    "op5_benchmark_decontamination": decontaminate.SQL,
    "op8_substring_dedup": substrings.SQL,
    "op9_suffix_array_dedup": suffixes.SQL,
    "op11_filter_audit": audit.SQL,
}
