"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from reprise.llm import decontaminate, langid, licenses, mixing, neardup, quality_mil, quality_rules, token_counts, toxicity, warc


def queries() -> dict:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_jaccard_join": neardup.op2_jaccard_join,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_language_id": langid.op4_language_id,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_quality_classifier": quality_mil.op7_quality_classifier,
        "op8_mixing": mixing.op8_mixing,
        "op9_warc": warc.op9_warc,
        "op10_decontaminate": decontaminate.op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_quality_rules": quality_rules.OP6_SQL,
        "op8_mixing": mixing.OP8_SQL,
        "op9_warc": warc.OP9_SQL,
        "op10_decontaminate": decontaminate.OP10_SQL,
    }
