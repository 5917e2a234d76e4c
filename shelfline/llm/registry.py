"""Queries and SQL of the corpus operators, by name."""

from __future__ import annotations

from shelfline.llm import bpe, conversation_repair, decontamination, fill_in_middle, language, lm_scoring, personal_data, quality_classifier, quality_rules, secrets, shingles, toxicity, warc

QUERIES = {
    "op4_ngram_jaccard_join": shingles.op4_ngram_jaccard_join,
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_language_id": language.op3_language_id,
    "op5_bpe_encoding": bpe.op5_bpe_encoding,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_warc": warc.op7_warc,
    "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_personal_data": personal_data.op13_personal_data,
}

SQL = {
    "op4_ngram_jaccard_join": shingles.OP4_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_benchmark_decontamination": decontamination.OP8_SQL,
    "op11_conversation_repair": conversation_repair.OP11_SQL,
    "op12_fill_in_middle": fill_in_middle.OP12_SQL,
}
