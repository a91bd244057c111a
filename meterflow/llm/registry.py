"""Queries and oracle SQL of this subpackage."""

from . import alignment, ann, bpe, extraction, hmm_model, jaccard_join, minhash_dedup, mixing, quality_classifier, quality_rules, substring_dedup, warc, whitening

QUERIES = {
    "op1_warc_dictionary": warc.op1_warc_dictionary,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_extract_main_text": extraction.op3_extract_main_text,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_bpe_tree": bpe.op6_bpe_tree,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_ngram_jaccard_join": jaccard_join.op8_ngram_jaccard_join,
    "op9_hmm_scoring": hmm_model.op9_hmm_scoring,
    "op10_ann_block_join": ann.op10_ann_block_join,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_whitening": whitening.op12_whitening,
    "op13_minhash_bayes": minhash_dedup.op13_minhash_bayes,
}

SQL = {
    "op1_warc_dictionary": warc.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op8_ngram_jaccard_join": jaccard_join.SQL,
    "op10_ann_block_join": ann.SQL,
    "op13_minhash_bayes": minhash_dedup.SQL,
}
