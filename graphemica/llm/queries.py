"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from graphemica.llm import chat_tree, decontaminate, language_id, license_scan, minhash_dedup, sentencepiece_viterbi, substring_dedup, token_records, url_filter, vector_search

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_substring_dedup,
        chat_tree.op2_chat_tree,
        token_records.op3_token_records,
        vector_search.op4_vector_search,
        decontaminate.op5_decontaminate,
        license_scan.op6_license_scan,
        minhash_dedup.op7_minhash_dedup,
        url_filter.op8_url_filter,
        sentencepiece_viterbi.op9_sentencepiece,
        language_id.op10_language_id,
    )
}
ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_chat_tree": chat_tree.SQL,
    "op4_vector_search": vector_search.SQL,
    "op8_url_filter": url_filter.SQL,
}
