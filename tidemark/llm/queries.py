"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, decontam, exact, katz, near, pii, suffix, toxicity, unigram

QUERIES = {
    "op1_katz_scoring": katz.op1_katz_scoring,
    "op2_pii_surrogates": pii.op2_pii_surrogates,
    "op3_bpe_round_trip": bpe.op3_bpe_round_trip,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_near_dedup": near.op6_near_dedup,
    "op7_token_counts": unigram.op7_token_counts,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_suffix_dedup": suffix.op10_suffix_dedup,
}
SQL = {"op5_exact_dedup": exact.SQL, "op6_near_dedup": near.SQL, "op8_decontamination": decontam.SQL, "op9_chat_formatting": chat.SQL, "op10_suffix_dedup": suffix.SQL}
