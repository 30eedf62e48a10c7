"""The queries of this subpackage and the SQL that checks them, where SQL can express them."""

from __future__ import annotations

from . import chat, decontam, flat_graph, html_text, line_dedup, near_dedup, packing, prefix_trie, quality, suffix_dedup, token_files, toxicity, turn_repair

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_chat_format": chat.op2_chat_format,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_html_text": html_text.op5_html_text,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_token_files": token_files.op9_token_files,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_flat_graph": flat_graph.op11_flat_graph,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
#: Those without a twin are held against brute force, exact round trips or held-out accuracy in tests/llm.
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op10_quality_rules": quality.oracle(),
    "op11_flat_graph": flat_graph.OP11_SQL,
    "op12_turn_repair": turn_repair.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
    "op2_chat_format": chat.oracle(),
    "op4_near_dedup": near_dedup.OP4_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
}
