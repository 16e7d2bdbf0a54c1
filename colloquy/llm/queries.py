"""The registered queries of the training-data operators."""

from __future__ import annotations

from . import brown_lm, exact_dedup, fill_in_middle, fingerprint, html_extract, jaccard_join, license_scan, media, packing, piece_sampling, quality, ranked_search, secret_scan

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_lm_scoring": brown_lm.op2_lm_scoring,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_fingerprint": fingerprint.op6_fingerprint,
    "op7_piece_sampling": piece_sampling.op7_piece_sampling,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_html_extract": html_extract.op9_html_extract,
    "op10_media_columns": media.op10_media_columns,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}
#: SQL where it can express the operator; the rest are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op11_ranked_search": ranked_search.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
}
