"""The registered queries of this subpackage and their SQL."""

from trajlake.llm import chat, decontaminate, extraction, langid, mixing, neardup, pii, quality, secrets, spelling, sql, toxicity, urls, whitening

QUERIES = {
    "op1_secret_scan": secrets.op1,
    "op2_toxicity": toxicity.op2,
    "op3_language_id": langid.op3,
    "op4_chat_formatting": chat.op4,
    "op5_url_filter": urls.op5,
    "op6_decontamination": decontaminate.op6,
    "op7_mixing": mixing.op7,
    "op8_pii": pii.op8,
    "op9_near_duplicates": neardup.op9,
    "op10_quality_rules": quality.op10,
    "op11_spelling_variants": spelling.op11,
    "op12_html_extraction": extraction.op12,
    "op13_embedding_whitening": whitening.op13,
}
ORACLE: dict[str, str] = {
    "op4_chat_formatting": sql.CHAT,
    "op7_mixing": sql.MIXING,
    "op9_near_duplicates": sql.NEAR_DUPLICATES,
    "op11_spelling_variants": sql.SPELLING_VARIANTS,
    "op12_html_extraction": sql.HTML_EXTRACTION,
}
