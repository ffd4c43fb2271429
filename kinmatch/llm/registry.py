"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontamination, jaccard_join, packing, pii, quality, secrets, sharding, token_store, url_filter


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_url_filters": url_filter.op2_url_filters,
        "op3_token_output": token_store.op3_token_output,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op4_secret_scans": secrets.op4_secret_scans,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_quality_rules": quality.op8_quality_rules,
        "op10_pii": pii.op10_pii,
        "op9_chat_formatting": chat.op9_chat_formatting,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_chat_formatting": chat.ORACLE_SQL}
