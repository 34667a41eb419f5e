"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from boxwright.llm import decontaminate, digests, html, language, pieces, quality, secrets, simhash, substrings, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_secrets": secrets.op2_secrets,
    "op3_fingerprint": digests.op3_fingerprint,
    "op4_html": html.op4_html,
    "op5_language": language.op5_language,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_warc": warc.op8_warc,
    "op9_simhash_dedup": simhash.op9_simhash_dedup,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "pages_language": language.pages_language,
}
ORACLE = {
    "op6_decontamination": decontaminate.ORACLE,
    "op8_warc": warc.ORACLE,
    "op10_substring_dedup": substrings.ORACLE,
}
