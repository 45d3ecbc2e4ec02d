"""Registry of the subpackage: a query for each operator, and SQL where SQL can express it."""

from __future__ import annotations

from patchweave.llm import chat, exact_dedup, hard_negatives, mixing, near_dedup, packing, pii, runs, secrets, substring_dedup, topk_search, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_pii": pii.op3_pii,
    "op4_pack": packing.op4_pack,
    "op5_arc_to_warc": warc.op5_arc_to_warc,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_topk_search": topk_search.op8_topk_search,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_chat_format": chat.op10_chat_format,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_runs": runs.op12_runs,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE = {
    "op5_arc_to_warc": warc.OP5_SQL,
    "op8_topk_search": topk_search.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_chat_format": chat.OP10_SQL,
    "op11_substring_dedup": substring_dedup.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
