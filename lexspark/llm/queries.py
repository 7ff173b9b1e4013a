"""The registered queries of this subpackage and their SQL."""

from . import chat_format, exact_dedup, line_dedup, near_dedup, piece_codec, quality, source_mix, token_rollup, url_filter, vector_search

_OPERATORS = {
    "op1_quality_classifier": quality,
    "op2_near_dedup": near_dedup,
    "op3_url_filter": url_filter,
    "op4_chat_format": chat_format,
    "op5_exact_dedup": exact_dedup,
    "op6_token_counts": token_rollup,
    "op7_nearest_vectors": vector_search,
    "op8_source_mix": source_mix,
    "op9_line_dedup": line_dedup,
    "op10_piece_codec": piece_codec,
}
QUERIES = {k: m.query for k, m in _OPERATORS.items()}
ORACLES = {k: m.SQL for k, m in _OPERATORS.items() if hasattr(m, "SQL")}
