"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, html_extract, importance, jaccard_join, langid, pii, ranked_search, segment, simhash, spotsigs, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_sentencepiece": segment.op1_sentencepiece,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_spotsigs": spotsigs.op4_spotsigs,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_pii": pii.op7_pii,
    "op8_language_id": langid.op8_language_id,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_html_extraction": html_extract.op10_html_extraction,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_ngram_jaccard": jaccard_join.op12_ngram_jaccard,
    "op13_importance_resampling": importance.op13_importance_resampling,
}

ORACLES = {
    "op2_suffix_dedup": suffix_dedup.ORACLE,
    "op4_spotsigs": spotsigs.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
    "op12_ngram_jaccard": jaccard_join.ORACLE,
    "op13_importance_resampling": importance.ORACLE,
}
