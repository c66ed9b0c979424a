"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from . import (
    cdc_dedup,
    chat_tree,
    decontam,
    entropy_mix,
    exact_dedup,
    hard_negatives,
    heap_kmeans,
    license_scan,
    ngram_join,
    pseudo_likelihood,
    quality_rules,
    toxicity_fm,
    warc,
)

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_decontam": decontam.op2_decontam,
    "op3_chat_tree": chat_tree.op3_chat_tree,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_warc": warc.op5_warc,
    "op6_toxicity": toxicity_fm.op6_toxicity,
    "op7_cdc_dedup": cdc_dedup.op7_cdc_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_pseudo_likelihood": pseudo_likelihood.op9_pseudo_likelihood,
    "op10_entropy_mix": entropy_mix.op10_entropy_mix,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_heap_kmeans": heap_kmeans.op13_heap_kmeans,
}

ORACLE = {
    "op2_decontam": decontam.ORACLE,
    "op3_chat_tree": chat_tree.ORACLE,
    "op4_license_scan": license_scan.ORACLE,
    "op5_warc": warc.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_quality_rules": quality_rules.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_heap_kmeans": heap_kmeans.ORACLE,
}
