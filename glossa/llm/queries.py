"""Queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import bpe, exact_dedup, fill_middle, jaccard_join, language_id, language_model, lexical_search, mixing, near_dedup, quality, substring_dedup, topk, url_filter


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_topk_search": topk.op2_topk_search,
        "op3_quality": quality.op3_quality,
        "op4_language_model": language_model.op4_language_model,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_language_id": language_id.op7_language_id,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "digest_index_batches": exact_dedup.digest_index_batches,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_jaccard_join": jaccard_join.op11_jaccard_join,
        "op12_fill_middle": fill_middle.op12_fill_middle,
        "op13_lexical_search": lexical_search.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk_search": topk.OP2_SQL,
        "op5_url_filter": url_filter.OP5_SQL,
        "op8_near_dedup": near_dedup.OP8_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "digest_index_batches": exact_dedup.BATCHES_SQL,
        "op10_mix_sources": mixing.OP10_SQL,
        "op11_jaccard_join": jaccard_join.OP11_SQL,
        "op12_fill_middle": fill_middle.OP12_SQL,
        "op13_lexical_search": lexical_search.OP13_SQL,
    }
