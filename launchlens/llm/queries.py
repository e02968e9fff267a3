"""The registered queries of the operators and the SQL that states them."""

from __future__ import annotations

from launchlens.llm import (
    bpe,
    decontaminate,
    jaccard,
    kd_shards,
    language,
    merkle,
    ngram_lm,
    secret_links,
    substrings,
    suffix_array,
    topk,
    toxicity,
    whitening,
)

QUERIES = {
    "op1_toxicity_chain": toxicity.query,
    "op2_language_filters": language.query,
    "op3_topk_search": topk.query,
    "op4_substring_dedup": substrings.query,
    "op5_jaccard_groups": jaccard.query,
    "op6_decontaminate": decontaminate.query,
    "op7_suffix_array": suffix_array.query,
    "op8_kd_shards": kd_shards.query,
    "op9_ngram_lm": ngram_lm.query,
    "op10_byte_bpe": bpe.query,
    "op11_embedding_whitening": whitening.query,
    "op12_merkle_manifest": merkle.query,
    "op13_secret_links": secret_links.query,
}
ORACLES: dict[str, str] = {
    "op3_topk_search": topk.SQL,
    "op4_substring_dedup": substrings.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op12_merkle_manifest": merkle.SQL,
}
