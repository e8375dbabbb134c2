"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

from landshift.llm import bpe, divergence, kd_search, language, line_dedup, mixing, periodic, quality_model, quality_rules, secrets, simhash, token_files, url_filter

QUERIES = {
    "op1_kd_top_k": kd_search.op1_kd_top_k,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_simhash": simhash.op4_simhash,
    "op5_language_id": language.op5_language_id,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_token_files": token_files.op8_token_files,
    "op9_quality_classifier": quality_model.op9_quality_classifier,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_secret_scan": secrets.op13_secret_scan,
}

ORACLE: dict[str, str] = {
    "op1_kd_top_k": kd_search.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_mix_sources": mixing.OP3_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
}
