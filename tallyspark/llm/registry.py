"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, codes, decontaminate, html, language, mixing, neardup, pii, quality, sharding, subword, token_output, whitening

QUERIES = {
    "op1_token_output": token_output.query,
    "op2_neardup": neardup.query,
    "op3_pii": pii.query,
    "op4_sharding": sharding.query,
    "op5_html": html.query,
    "op6_chat": chat.query,
    "op7_quality": quality.query,
    "op8_language": language.query,
    "op9_subword": subword.query,
    "op10_decontaminate": decontaminate.query,
    "op11_vector_codes": codes.query,
    "op12_mixing": mixing.query,
    "op13_whitening": whitening.query,
}

ORACLES: dict[str, str] = {
    "op6_chat": chat.ORACLE,
    "op7_quality": quality.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
}
