"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, mixing, mpeg_audio, near_dedup, pii, quality, simhash, substring_dedup, toxicity, url_filter, vector_codes, whitening

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_bpe": bpe.op5_bpe,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_ann": ann.op7_ann,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality": quality.op9_quality,
    "op10_mpeg_audio": mpeg_audio.op10_mpeg_audio,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_whitening": whitening.op12_whitening,
    "op13_simhash": simhash.op13_simhash,
}

ORACLES = {
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_url_filter": url_filter.ORACLE_SQL,
    "op6_near_dedup": near_dedup.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
}
