"""Queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from . import op01_repair, op02_prefix_counts, op03_curve_packing, op04_rules, op05_byte_bpe, op06_dual_tree, op07_urls, op08_language, op09_near_dups, op10_media, op11_simhash, op12_delta_lloyd, op13_collocations


def queries() -> dict:
    return {
        "op1_repair_shards": op01_repair.op1_repair_shards,
        "op2_prefix_counts": op02_prefix_counts.op2_prefix_counts,
        "op3_curve_packing": op03_curve_packing.op3_curve_packing,
        "op4_rule_ensemble": op04_rules.op4_rule_ensemble,
        "op5_byte_bpe": op05_byte_bpe.op5_byte_bpe,
        "op6_dual_tree_top_k": op06_dual_tree.op6_dual_tree_top_k,
        "op7_url_filter": op07_urls.op7_url_filter,
        "op8_language_id": op08_language.op8_language_id,
        "op9_near_duplicates": op09_near_dups.op9_near_duplicates,
        "op10_audio_features": op10_media.op10_audio_features,
        "op11_simhash_components": op11_simhash.op11_simhash_components,
        "op12_delta_lloyd": op12_delta_lloyd.op12_delta_lloyd,
        "op13_collocations": op13_collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_dual_tree_top_k": op06_dual_tree.ORACLE,
        "op7_url_filter": op07_urls.ORACLE,
        "op12_delta_lloyd": op12_delta_lloyd.ORACLE,
        "op13_collocations": op13_collocations.ORACLE,
    }
