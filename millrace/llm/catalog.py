"""Queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
from millrace.llm import alignment, chaining, chat, collocation, decontaminate, exact_dedup, licenses, packing, pivots, quality, sharding, simhash, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_feistel_sharding": sharding.op3_feistel_sharding,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_substring_dedup": chaining.op6_substring_dedup,
    "op7_packing": packing.op7_packing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_cross_tokenizer_alignment": alignment.op11_cross_tokenizer_alignment,
    "op12_phrase_collocations": collocation.op12_phrase_collocations,
    "op13_embedding_near_dedup": pivots.op13_embedding_near_dedup,
}

ORACLES = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_benchmark_decontamination": decontaminate.OP4_SQL,
    "op10_license_scan": licenses.OP10_SQL,
    "op12_phrase_collocations": collocation.OP12_SQL,
    "op13_embedding_near_dedup": pivots.OP13_SQL,
}

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
