"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tracelab.llm import centroids, chat, exact_dedup, language, media, mixing, negatives, packing, quality, secrets, simhash, substrings, token_counts

QUERIES = {
    f.__name__: f
    for f in (
        token_counts.op1_token_counts,
        quality.op2_quality_resampling,
        exact_dedup.op3_exact_dedup,
        substrings.op4_substring_dedup,
        mixing.op5_source_mixing,
        simhash.op6_simhash_near_dedup,
        chat.op7_chat_format,
        language.op8_language_id,
        packing.op9_best_fit_packing,
        media.op10_media_columns,
        negatives.op11_hard_negatives,
        secrets.op12_secret_scan,
        centroids.op13_centroids,
    )
}
SQL = {"op3_exact_dedup": exact_dedup.SQL, "op4_substring_dedup": substrings.SQL, "op11_hard_negatives": negatives.SQL, "op13_centroids": centroids.SQL}
