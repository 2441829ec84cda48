"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import html_text, mixing, near_duplicates, nearest, packing, pii, quality, token_counts, token_output, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_nearest": nearest.op2_nearest,
    "op3_ngram_jaccard": near_duplicates.op3_ngram_jaccard,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_packing": packing.op5_packing,
    "op6_mixing": mixing.op6_mixing,
    "op7_pii": pii.op7_pii,
    "op8_html_text": html_text.op8_html_text,
    "op9_token_output": token_output.op9_token_output,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES = {"op6_mixing": mixing.OP6_SQL}
