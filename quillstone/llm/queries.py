"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from quillstone.llm import bpe, decontamination, html_text, lexical_search, ngram_join, quality, sharding, simhash, suffix_dedup, token_counts, token_store, url_filters, whitening

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_sharding": sharding.op2_sharding,
    "op3_token_store": token_store.op3_token_store,
    "op4_simhash": simhash.op4_simhash,
    "op5_bpe": bpe.op5_bpe,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_html_text": html_text.op9_html_text,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_ranked_search": lexical_search.op12_ranked_search,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL = {"op1_url_filters": url_filters.SQL, "op8_decontamination": decontamination.SQL, "op11_ngram_join": ngram_join.SQL, "op12_ranked_search": lexical_search.SQL}
