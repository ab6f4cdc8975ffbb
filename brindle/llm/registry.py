"""Queries of this subpackage, by name."""

from __future__ import annotations

from . import chat, divergence, grammar, hard_negatives, licences, mixing, packing, quality, shortest_pack, simhash, token_counts, warc, winnowing


def queries():
    return {
        "op1_source_mixing": mixing.query,
        "op2_licence_scan": licences.query,
        "op3_quality_rules": quality.query,
        "op4_grammar_token_files": grammar.query,
        "op5_winnowing_fingerprints": winnowing.query,
        "op6_best_fit_packing": packing.query,
        "op7_simhash_near_duplicates": simhash.query,
        "op8_chat_role_repair": chat.query,
        "op9_token_counts": token_counts.query,
        "op10_warc_archive": warc.query,
        "op11_hard_negatives": hard_negatives.query,
        "op12_shortest_pack_first": shortest_pack.query,
        "op13_source_divergence": divergence.query,
    }


def oracle_sql():
    return {"op10_warc_archive": warc.SQL, "op11_hard_negatives": hard_negatives.SQL, "op13_source_divergence": divergence.SQL}
