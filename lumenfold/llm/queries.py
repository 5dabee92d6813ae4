"""The registered queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from . import digest, grammar, lines, mixing, packing, rules, shards, simhash, substrings, urls

QUERIES = {
    "op1_line_quality": lines.query,
    "op2_pfair_mix": mixing.query,
    "op3_slot_shards": shards.query,
    "op4_quality_rules": rules.query,
    "op5_bin_slack_packing": packing.query,
    "op6_repeated_windows": substrings.query,
    "op7_repair_ids": grammar.query,
    "op8_simhash_components": simhash.query,
    "op9_quartile_digest": digest.query,
    "op10_url_trees": urls.query,
}
ORACLES = {
    "op2_pfair_mix": mixing.SQL,
    "op4_quality_rules": rules.SQL,
}
