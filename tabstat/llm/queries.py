"""Queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

from . import align, bpe, chains, chat, decontaminate, exact, line_dedup, lm, ngram_join, pii, quality, resample, warc_zip

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_bpe": bpe.op2_bpe,
    "op3_substring_dedup": chains.op3_substring_dedup,
    "op4_ngram_jaccard": ngram_join.op4_ngram_jaccard,
    "op5_chat_format": chat.op5_chat_format,
    "op6_lm_scoring": lm.op6_lm_scoring,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_warc_zip": warc_zip.op8_warc_zip,
    "op9_pii_semicrf": pii.op9_pii_semicrf,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_importance_resampling": resample.op11_importance_resampling,
    "op12_tokenizer_alignment": align.op12_tokenizer_alignment,
    "op13_exact_dedup": exact.op13_exact_dedup,
}
ORACLES = {
    "op1_decontamination": decontaminate.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op6_lm_scoring": lm.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op8_warc_zip": warc_zip.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_importance_resampling": resample.ORACLE,
    "op13_exact_dedup": exact.ORACLE,
}
