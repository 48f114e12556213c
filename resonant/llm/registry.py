"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from resonant.llm import exact_dedup, html_text, language_id, license_scan, mixing, near_dedup, neighbours, packing, token_counts, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        html_text.op1_main_text,
        mixing.op2_source_mix,
        packing.op3_cost_packing,
        license_scan.op4_license_scan,
        exact_dedup.op5_exact_dedup,
        language_id.op6_language_id,
        near_dedup.op7_near_duplicates,
        neighbours.op8_nearest_neighbours,
        token_counts.op9_token_counts,
        toxicity.op10_toxicity,
    )
}

ORACLES = {"op4_license_scan": license_scan.SQL, "op5_exact_dedup": exact_dedup.SQL}
