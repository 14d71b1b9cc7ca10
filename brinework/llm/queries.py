"""Queries of this package, and their SQL where it can state them."""

from __future__ import annotations

from . import components, mixing, neardup, noise, survivors, tokens, truncation


def queries() -> dict:
    return {
        "p2_found": components.p2_found,
        "p3_found": noise.p3_found,
        "p3_text": noise.p3_text,
        "p4_found": neardup.p4_found,
        "p4_classes": neardup.p4_classes,
        "p5_found": survivors.p5_found,
        "p5_records": survivors.p5_records,
        "p6_ids": tokens.p6_ids,
        "p7_mix": mixing.p7_mix,
        "p7_shares": mixing.p7_shares,
        "p7_shares_full": mixing.p7_shares_full,
        "p7_mix_full": mixing.p7_mix_full,
        "p7_invariants": mixing.p7_invariants,
        "p8_found": truncation.p8_found,
        "p8_shares": truncation.p8_shares,
    }


def oracle_sql() -> dict[str, str]:
    return {"p2_found": components.P2_ORACLE, "p4_found": neardup.P4_ORACLE, "p5_found": survivors.P5_ORACLE}
