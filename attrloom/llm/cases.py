"""The registered queries of this package and their SQL."""

from __future__ import annotations

from attrloom.llm import bpe, chat, collocations, decontaminate, negatives, packing, pages, pii, simhash, sketch, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_chat": chat.op3_chat,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash": simhash.op5_simhash,
    "op6_fingerprint": sketch.op6_fingerprint,
    "op7_packing": packing.op7_packing,
    "op8_pii": pii.op8_pii,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_page_text": pages.op12_page_text,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op3_chat": chat.OP3_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_page_text": pages.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
