"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from . import (
    collocations,
    decontamination,
    exact_dedup,
    fill_in_middle,
    language_id,
    mixing,
    ngram_join,
    quality_rules,
    sentencepiece_dropout,
    sharding,
    suffix_dedup,
    token_counts,
    url_filters,
)

QUERIES = {
    "op1_quality_llr": quality_rules.op1_quality_llr,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_suffix_array_dedup": suffix_dedup.op3_suffix_array_dedup,
    "op4_sentencepiece_dropout": sentencepiece_dropout.op4_sentencepiece_dropout,
    "op5_minimax_shards": sharding.op5_minimax_shards,
    "op6_mix_to_targets": mixing.op6_mix_to_targets,
    "op7_language_id": language_id.op7_language_id,
    "op8_url_filter": url_filters.op8_url_filter,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_benchmark_decontamination": decontamination.op11_benchmark_decontamination,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_phrase_collocations": collocations.op13_phrase_collocations,
}

ORACLE_SQL = {
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_benchmark_decontamination": decontamination.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_phrase_collocations": collocations.ORACLE,
}
