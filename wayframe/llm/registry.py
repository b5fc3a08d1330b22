"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from . import bpe_count, line_dedup, middle_fill, mixing, ngram_join, period_runs, piece_nbest, pii_crf, prefix_forest, quality_cnn, quality_rules, secret_scan, shuffle_shards

QUERIES = {
    "op1_quality_classifier": quality_cnn.op1_quality_classifier,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_sentencepiece": piece_nbest.op4_sentencepiece,
    "op5_mix": mixing.op5_mix,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_pii": pii_crf.op7_pii,
    "op8_prefix_forest": prefix_forest.op8_prefix_forest,
    "op9_token_counts": bpe_count.op9_token_counts,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op10_passage_dedup": line_dedup.op10_passage_dedup,
    "op11_shards": shuffle_shards.op11_shards,
    "op12_period_runs": period_runs.op12_period_runs,
    "op13_middle_fill": middle_fill.op13_middle_fill,
}
SQL = {
    "op2_quality_rules": quality_rules.SQL,
    "op5_mix": mixing.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op13_middle_fill": middle_fill.SQL,
}
