"""The queries of this subpackage and the SQL that gives the same rows, by name."""

from __future__ import annotations

from heddle.llm import (
    chat, chunks, collocations, decompose, decontaminate, packing, periodic, pii, quality, simhash, suffixes, urls, wavelet,
)

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_url_filters": urls.op3_url_filters,
    "op4_simhash": simhash.op4_simhash,
    "op5_pii": pii.op5_pii,
    "op6_substring_dedup": chunks.op6_substring_dedup,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_token_binary": wavelet.op9_token_binary,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_phrase_collocations": collocations.op11_phrase_collocations,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_power_packing": decompose.op13_power_packing,
}

ORACLES: dict[str, str] = {
    "op1_chat_formatting": chat.ORACLE_SQL,
    "op3_url_filters": urls.ORACLE_SQL,
    "op7_decontamination": decontaminate.ORACLE_SQL,
    "op8_quality_rules": quality.ORACLE_SQL,
    "op11_phrase_collocations": collocations.ORACLE_SQL,
}
