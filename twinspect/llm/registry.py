"""The queries of this subpackage, one for each operator, and the SQL for those that SQL can express."""

from __future__ import annotations

from twinspect.llm import chat, decontam, htmltext, lexical, mixing, neardup, quality, repeats, resampling, sharding, tokens, toxicity, warc

QUERIES = {
    "op1_mcd_outliers": quality.op1_mcd_outliers,
    "op2_factorization_toxicity": toxicity.op2_factorization_toxicity,
    "op3_bwt_repeats": repeats.op3_bwt_repeats,
    "op4_transducer_tokens": tokens.op4_transducer_tokens,
    "op5_spaced_seed_decontam": decontam.op5_spaced_seed_decontam,
    "op6_reply_tree_chat": chat.op6_reply_tree_chat,
    "op7_bottom_k_near_dup": neardup.op7_bottom_k_near_dup,
    "op8_layout_text": htmltext.op8_layout_text,
    "op9_efraimidis_mix": mixing.op9_efraimidis_mix,
    "op10_byte_prefix_shards": sharding.op10_byte_prefix_shards,
    "op11_bit_sliced_search": lexical.op11_bit_sliced_search,
    "op12_capture_index": warc.op12_capture_index,
    "op13_suffix_array_resample": resampling.op13_suffix_array_resample,
}
SQL = {
    "op1_mcd_outliers": quality.SQL,
    "op9_efraimidis_mix": mixing.SQL,
    "op10_byte_prefix_shards": sharding.SQL,
    "op11_bit_sliced_search": lexical.SQL,
    "op12_capture_index": warc.SQL,
    "op13_suffix_array_resample": resampling.SQL,
}
