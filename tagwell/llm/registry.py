"""The subpackage's queries and their DuckDB counterparts."""

from tagwell.llm import bpe, fingerprint, language_id, secrets_crf, shingle_join, source_mix, suffix_dedup, token_files, topk, url_filter

QUERIES = {
    "op1_secret_scan": secrets_crf.op1_secret_scan,
    "op2_source_mix": source_mix.op2_source_mix,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_token_files": token_files.op4_token_files,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_ngram_jaccard": shingle_join.op6_ngram_jaccard,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_language_id": language_id.op8_language_id,
    "op9_exact_topk": topk.op9_exact_topk,
    "op10_fingerprints": fingerprint.op10_fingerprints,
}
ORACLES = {"op6_ngram_jaccard": shingle_join.ORACLE, "op7_url_filter": url_filter.ORACLE, "op9_exact_topk": topk.ORACLE}
