"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, decontaminate, exact_dedup, filter_audit, matroska, ngram_join, packing, quality, secrets, substring_dedup, token_files, toxicity, yinyang

QUERIES = {
    "op10_substring_dedup": substring_dedup.op10,
    "op1_ngram_join": ngram_join.op1,
    "op5_toxicity": toxicity.op5,
    "op8_quality": quality.op8,
    "op9_matroska": matroska.op9,
    "op3_secrets": secrets.op3,
    "op6_byte_bpe": byte_bpe.op6,
    "op2_token_files": token_files.op2,
    "op4_packing": packing.op4,
    "op7_exact_dedup": exact_dedup.op7,
    "op11_decontaminate": decontaminate.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_yinyang": yinyang.op13,
}

ORACLES = {
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op11_decontaminate": decontaminate.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_yinyang": yinyang.ORACLE,
}
