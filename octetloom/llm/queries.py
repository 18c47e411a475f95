"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from octetloom.llm import mixing, packing, pii, quality, simhash, substrings, toolcalls, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_exact_top_k": topk.op1_exact_top_k,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_pii": pii.op3_pii,
        "op4_warc_packages": warc.op4_warc_packages,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_substring_dedup": substrings.op6_substring_dedup,
        "op7_tool_calls": toolcalls.op7_tool_calls,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_simhash": simhash.op9_simhash,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_top_k": topk.ORACLE_SQL,
        "op4_warc_packages": warc.ORACLE_SQL,
        "op5_mix_sources": mixing.ORACLE_SQL,
        "op6_substring_dedup": substrings.ORACLE_SQL,
        "op7_tool_calls": toolcalls.ORACLE_SQL,
    }
