"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontam, mixing, quality, search, simhash, substring, toxicity, urlfilter, warc

QUERIES = {
    "op1_url_filter": urlfilter.op1,
    "op2_toxicity_ssk": toxicity.op2,
    "op3_simhash_neardup": simhash.op3,
    "op4_suffix_array_dedup": substring.op4,
    "op5_bm25_topk": search.op5,
    "op6_mixing": mixing.op6,
    "op7_warc_derivatives": warc.op7,
    "op8_quality_qda": quality.op8,
    "op9_chat_format": chat.op9,
    "op10_decontamination": decontam.op10,
}
ORACLES: dict[str, str] = {
    "op1_url_filter": urlfilter.OP1_SQL,
    "op9_chat_format": chat.OP9_SQL,
}
