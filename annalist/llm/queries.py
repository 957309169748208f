"""The registered corpus queries and their SQL."""

from __future__ import annotations

from annalist.llm import bpe, chat, debruijn, jaccard, mixing, quality, repair, secret_scan, sharding, spelling, suffix_dedup, topk, warc

QUERIES = {
    "op1_tiled_topk": topk.op1_tiled_topk,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_secret_automaton": secret_scan.op4_secret_automaton,
    "op5_perspective_rotation": chat.op5_perspective_rotation,
    "op6_merge_replay": bpe.op6_merge_replay,
    "op7_feistel_sharding": sharding.op7_feistel_sharding,
    "op8_zip_warc": warc.op8_zip_warc,
    "op9_prefix_tree_join": jaccard.op9_prefix_tree_join,
    "op10_line_quality": quality.op10_line_quality,
    "op11_debruijn_dedup": debruijn.op11_debruijn_dedup,
    "op12_rank_repair": repair.op12_rank_repair,
    "op13_variant_automata": spelling.op13_variant_automata,
}

ORACLE_SQL = {
    "op1_tiled_topk": topk.SQL,
    "op5_perspective_rotation": chat.SQL,
    "op8_zip_warc": warc.SQL,
    "op9_prefix_tree_join": jaccard.SQL,
    "op10_line_quality": quality.SQL,
    "op11_debruijn_dedup": debruijn.SQL,
    "op12_rank_repair": repair.SQL,
    "op13_variant_automata": spelling.SQL,
}
