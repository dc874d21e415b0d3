"""The queries of this subpackage, one for each operator, and their DuckDB oracles where SQL expresses them."""

from fleetlens.llm import filteraudit, hardneg, license, mixing, multiindex, neardup, ngram, packing, quality, tokencount, toxicity, urlfilter, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_multi_index": multiindex.op2_multi_index,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_url_filter": urlfilter.op4_url_filter,
    "op5_mix": mixing.op5_mix,
    "op6_license_scan": license.op6_license_scan,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_warc": warc.op8_warc,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_lm_scores": ngram.op10_lm_scores,
    "op11_hard_negatives": hardneg.op11_hard_negatives,
    "op12_filter_audit": filteraudit.op12_filter_audit,
    "op13_token_counts": tokencount.op13_token_counts,
}
ORACLES = {
    "op4_url_filter": urlfilter.oracle(),
    "op6_license_scan": license.oracle(),
    "op7_near_duplicates": neardup.oracle(),
    "op8_warc": warc.ORACLE,
    "op9_quality_rules": quality.oracle(),
    "op11_hard_negatives": hardneg.ORACLE,
    "op12_filter_audit": filteraudit.ORACLE,
}
