"""Queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

from . import (
    best_fit, byte_bpe, chat_collapse, filter_diagram, line_dedup, media_archive, ngram_trie, quality_rules, secret_scan, simhash_mih, spelling,
    suffix_dedup, token_orc,
)


def queries() -> dict:
    return {
        "op1_ngram_trie": ngram_trie.op1_ngram_trie,
        "op2_media_archive": media_archive.op2_media_archive,
        "op3_token_orc": token_orc.op3_token_orc,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_chat_collapse": chat_collapse.op5_chat_collapse,
        "chat_snapshot_links": chat_collapse.chat_snapshot_links,
        "op6_best_fit_packing": best_fit.op6_best_fit_packing,
        "op7_quality_ledger": quality_rules.op7_quality_ledger,
        "rule_ablations": quality_rules.rule_ablations,
        "op8_segment_tree_bpe": byte_bpe.op8_segment_tree_bpe,
        "op9_secret_spans": secret_scan.op9_secret_spans,
        "op10_simhash_groups": simhash_mih.op10_simhash_groups,
        "op11_filter_audit": filter_diagram.op11_filter_audit,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_line_dedup": line_dedup.op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_collapse": chat_collapse.ORACLE, "chat_snapshot_links": chat_collapse.LINKS, "op7_quality_ledger": quality_rules.ORACLE, "rule_ablations": quality_rules.ABLATIONS,
        "op11_filter_audit": filter_diagram.ORACLE, "op13_line_dedup": line_dedup.ORACLE,
    }
