"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, language_id, license_scan, line_dedup, lm_score, ngram_join, pieces, prefix_trie, resample, token_output, url_filter, vector_codes


def queries() -> dict:
    return {
        "op1_lm_score": lm_score.op1_lm_score,
        "op2_language_id": language_id.op2_language_id,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_resample": resample.op4_resample,
        "op5_pieces": pieces.op5_pieces,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_token_output": token_output.op10_token_output,
        "op11_url_filter": url_filter.op11_url_filter,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict:
    return {"op6_exact_dedup": exact_dedup.OP6_SQL, "op8_decontaminate": decontaminate.OP8_SQL, "op12_vector_codes": vector_codes.OP12_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
