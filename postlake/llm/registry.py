"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, chat, collocations, decontaminate, fingerprint, jaccard, neardup, pii, quality, repeats, sharding, toxicity, vectorcodes


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_bpe": bpe.op2_bpe,
        "op3_neardup": neardup.op3_neardup,
        "op4_quality": quality.op4_quality,
        "op5_chat": chat.op5_chat,
        "op6_fingerprints": fingerprint.op6_fingerprints,
        "op7_pii": pii.op7_pii,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_sharding": sharding.op9_sharding,
        "op10_repeats": repeats.op10_repeats,
        "op11_collocations": collocations.op11_collocations,
        "op12_jaccard": jaccard.op12_jaccard,
        "op13_vectorcodes": vectorcodes.op13_vectorcodes,
    }


def oracle_sql() -> dict:
    return {"op1_decontaminate": decontaminate.ORACLE, "op5_chat": chat.ORACLE, "op9_sharding": sharding._sql(), "op11_collocations": collocations.ORACLE, "op13_vectorcodes": vectorcodes.ORACLE}
