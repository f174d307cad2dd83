"""One query for each operator, over its whole table."""

from __future__ import annotations

from subspark.llm import chat_format, chunk_dedup, decontaminate, divergence, line_dedup, mixing, packing, quality_rules, resample, search, simhash, suffix_dedup, token_counts
from subspark.llm.common import table


def queries() -> dict:
    return {
        "op1_packing": lambda s, d: packing.op1(table(s, d, "documents")),
        "op2_simhash": lambda s, d: simhash.op2(table(s, d, "documents")),
        "op3_decontaminate": lambda s, d: decontaminate.op3(table(s, d, "documents"), table(s, d, "benchmark")),
        "op4_resample": lambda s, d: resample.op4(table(s, d, "documents"), table(s, d, "labels")),
        "op5_chunk_dedup": lambda s, d: chunk_dedup.op5(table(s, d, "documents")),
        "op6_chat_format": lambda s, d: chat_format.op6(table(s, d, "conversations")),
        "op7_token_counts": lambda s, d: token_counts.op7(table(s, d, "documents")),
        "op8_quality_rules": lambda s, d: quality_rules.op8(table(s, d, "documents")).drop("rejected_by"),
        "op9_suffix_dedup": lambda s, d: suffix_dedup.op9(table(s, d, "documents")),
        "op10_line_dedup": lambda s, d: line_dedup.op10(table(s, d, "documents")),
        "op11_mixing": lambda s, d: mixing.op11(table(s, d, "documents")),
        "op12_divergence": lambda s, d: divergence.op12(table(s, d, "documents")),
        "op13_search": lambda s, d: search.op13(table(s, d, "documents"), table(s, d, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": decontaminate.ORACLE,
        "op6_chat_format": chat_format.ORACLE,
        "op8_quality_rules": quality_rules.ORACLE,
        "op10_line_dedup": line_dedup.ORACLE,
        "op11_mixing": mixing.ORACLE,
        "op12_divergence": divergence.ORACLE,
        "op13_search": search.ORACLE,
    }
