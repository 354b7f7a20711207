"""The queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

from . import centroids, decontaminate, langid, mixing, multi_index, ngram_join, periodic, secrets, substring_dedup, suffix_dedup, tokens, topk, toxicity


def queries():
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_language": langid.op2_language,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_mixing": mixing.op4_mixing,
        "op5_secrets": secrets.op5_secrets,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_tokens": tokens.op8_tokens,
        "op9_topk": topk.op9_topk,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_near_vectors": multi_index.op12_near_vectors,
        "op13_centroids": centroids.op13_centroids,
    }


def oracle_sql():
    return {"op3_ngram_join": ngram_join.SQL, "op4_mixing": mixing.SQL, "op9_topk": topk.SQL, "op12_near_vectors": multi_index.SQL, "op13_centroids": centroids.SQL}
