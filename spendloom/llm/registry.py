"""Queries of this subpackage and the SQL that says the same, where SQL can."""

from spendloom.llm import (
    op1_decontamination,
    op2_repetition,
    op3_language,
    op4_licenses,
    op5_pseudonyms,
    op6_token_counts,
    op7_suffix_dedup,
    op8_jaccard_join,
    op9_urls,
    op10_packing,
    op11_conversations,
    op12_html,
    op13_divergence,
)


def queries() -> dict:
    functions = (
        op1_decontamination.op1_decontamination,
        op2_repetition.op2_repetition,
        op3_language.op3_language,
        op4_licenses.op4_licenses,
        op5_pseudonyms.op5_pseudonyms,
        op6_token_counts.op6_token_counts,
        op7_suffix_dedup.op7_suffix_dedup,
        op8_jaccard_join.op8_jaccard_join,
        op9_urls.op9_urls,
        op10_packing.op10_packing,
        op11_conversations.op11_conversations,
        op12_html.op12_html,
        op13_divergence.op13_divergence,
    )
    return {f.__name__: f for f in functions}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": op1_decontamination.ORACLE_SQL,
        "op9_urls": op9_urls.ORACLE_SQL,
        "op11_conversations": op11_conversations.ORACLE_SQL,
        "op13_divergence": op13_divergence.ORACLE_SQL,
    }
