"""Queries of the training-data operators and the SQL for those that SQL can state."""

from __future__ import annotations

from .exact_dedup import OP8_SQL, op8_exact_dedup
from .html_extract import op4_html_extract
from .license_scan import op7_license_scan
from .lm_score import op9_lm_score
from .quality_classifier import op10_quality_classifier
from .sentencepiece_codec import op2_sentencepiece
from .simhash import op5_simhash
from .source_mix import OP6_SQL, op6_source_mix
from .token_counts import op1_token_counts
from .topk_search import OP3_SQL, op3_topk_search

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_topk_search": op3_topk_search,
    "op4_html_extract": op4_html_extract,
    "op5_simhash": op5_simhash,
    "op6_source_mix": op6_source_mix,
    "op7_license_scan": op7_license_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_lm_score": op9_lm_score,
    "op10_quality_classifier": op10_quality_classifier,
}
ORACLES = {"op3_topk_search": OP3_SQL, "op6_source_mix": OP6_SQL, "op8_exact_dedup": OP8_SQL}
