"""The queries of this package and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from panelforge.llm import chunks, decontaminate, jaccard, linededup, mixing, ngramlm, quality, secrets, sharding, topk

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_mixing": mixing.op2_mixing,
    "op3_secrets": secrets.op3_secrets,
    "op4_sharding": sharding.op4_sharding,
    "op5_topk": topk.op5_topk,
    "op6_quality": quality.op6_quality,
    "op7_lm": ngramlm.op7_lm,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_substring_dedup": chunks.op9_substring_dedup,
    "op10_line_dedup": linededup.op10_line_dedup,
}

ORACLES = {
    "op1_decontamination": decontaminate.ORACLE,
    "op5_topk": topk.ORACLE,
    "op8_jaccard": jaccard.ORACLE,
    "op10_line_dedup": linededup.ORACLE,
}
