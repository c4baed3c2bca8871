"""The subpackage's named queries and the SQL that checks them."""

from askbase.llm import (decontaminate, extract, jaccard_join, license_scan, line_dedup, lm, pieces, quality, runs, shards,
                         simhash, variants, warc)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_token_shards": shards.op2_token_shards,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_lm_scoring": lm.op4_lm_scoring,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_html_extraction": extract.op6_html_extraction,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_ngram_jaccard_join": jaccard_join.op11_ngram_jaccard_join,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_spelling_variants": variants.op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op5_decontamination": decontaminate.SQL,
    "op7_warc_revisits": warc.SQL,
}
