"""The queries and oracle SQL of this subpackage."""

from __future__ import annotations

from evigrain.llm import backoff_lm, best_fit, bpe, chat_format, grid_join, hilbert_shards, line_templates, minhash_dedup, packing, prefix_trie, quality_rules, turn_repair, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_backoff_lm": backoff_lm.op2_backoff_lm,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_line_templates": line_templates.op5_line_templates,
    "op5_passages": line_templates.op5_passages,
    "op6_packing": packing.op6_packing,
    "op7_bpe": bpe.op7_bpe,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_grid_order_join": grid_join.op9_grid_order_join,
    "op10_hilbert_sharding": hilbert_shards.op10_hilbert_sharding,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "op13_best_fit": best_fit.op13_best_fit,
}
ORACLE_SQL = {
    "op5_line_templates": line_templates.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_turn_repair": turn_repair.ORACLE,
}
