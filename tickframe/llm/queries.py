"""The registered queries of the training-data operators and their DuckDB counterparts.

Where no SQL is given, SQL cannot express the result (tokenizers, trained models, hashes of this package, random rounding)
or is too slow on whole tables; tests then compare the query's operator with a brute-force version.
"""

from __future__ import annotations

from . import op1_substring, op2_tokens, op3_jaccard, op4_lempel_ziv, op5_descent, op6_lines, op7_pieces, op8_quotes, op9_language, op10_mix

QUERIES = {
    "op1_substring_dedup": op1_substring.op1_substring_dedup,
    "op2_token_counts": op2_tokens.op2_token_counts,
    "op3_ngram_jaccard": op3_jaccard.op3_ngram_jaccard,
    "op4_lempel_ziv": op4_lempel_ziv.op4_lempel_ziv,
    "op5_embedding_dedup": op5_descent.op5_embedding_dedup,
    "op6_line_dedup": op6_lines.op6_line_dedup,
    "op7_sentencepiece": op7_pieces.op7_sentencepiece,
    "op8_quotation_linking": op8_quotes.op8_quotation_linking,
    "quoted_conversations": op8_quotes.quoted_conversations,
    "op9_language_id": op9_language.op9_language_id,
    "op10_mix": op10_mix.op10_mix,
}
ORACLE_SQL = {
    "op1_substring_dedup": op1_substring.ORACLE_SQL,
    "op3_ngram_jaccard": op3_jaccard.ORACLE_SQL,
    "op5_embedding_dedup": op5_descent.ORACLE_SQL,
    "op6_line_dedup": op6_lines.ORACLE_SQL,
    "op8_quotation_linking": op8_quotes.ORACLE_SQL,
    "quoted_conversations": op8_quotes.QUOTED_SQL,
}
