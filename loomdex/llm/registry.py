"""Queries and oracle SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from loomdex.llm import bpe, contexts, divergence, filters, jaccard, lines, minhash, mixing, nearest, quality, sharding, suffixes, warc


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_lines": lines.op2_lines,
        "op3_minhash": minhash.op3_minhash,
        "op4_quality": quality.op4_quality,
        "op5_nearest": nearest.op5_nearest,
        "op6_warc": warc.op6_warc,
        "op7_sharding": sharding.op7_sharding,
        "op8_jaccard": jaccard.op8_jaccard,
        "op9_mixing": mixing.op9_mixing,
        "op10_suffixes": suffixes.op10_suffixes,
        "op11_filters": filters.op11_filters,
        "op12_contexts": contexts.op12_contexts,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {**lines.ORACLE, **warc.ORACLE, **filters.ORACLE, **divergence.ORACLE}
