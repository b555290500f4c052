"""The queries of the corpus operators, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from . import bpe, conversation_repair, conversation_trie, extraction, fingerprints, jaccard, katz, language, licenses, mixing, quality, secret_scan, tokens

QUERIES = {
    "op1_source_mixing": mixing.query,
    "op2_html_extraction": extraction.query,
    "op3_token_counts": tokens.query,
    "op4_katz_scoring": katz.query,
    "op5_lcp_fingerprints": fingerprints.query,
    "op6_bpe_round_trip": bpe.query,
    "op7_license_scan": licenses.query,
    "op8_ngram_jaccard": jaccard.query,
    "op9_language_id": language.query,
    "op10_quality_rules": quality.query,
    "op11_secret_scan": secret_scan.query,
    "op12_prefix_trie": conversation_trie.query,
    "op13_structure_repair": conversation_repair.query,
}

#: The results of the first ten depend on trained models or on libraries that SQL does not have.
ORACLE_SQL = {
    "op11_secret_scan": secret_scan.SQL,
    "op12_prefix_trie": conversation_trie.SQL,
    "op13_structure_repair": conversation_repair.SQL,
}
