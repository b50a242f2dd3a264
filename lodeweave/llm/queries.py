"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from lodeweave.llm import brown, chat, collocations, decontam, jaccard, mixing, secrets, sentencepiece_codec, sharding, topk, toxicity, warc, whitening

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_topk": topk.op3_topk,
    "op4_warc": warc.op4_warc,
    "op5_chat_format": chat.op5_chat_format,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
    "op8_lm_scoring": brown.op8_lm_scoring,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_whitening": whitening.op11_whitening,
    "op12_mixing": mixing.op12_mixing,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op3_topk": topk.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op6_decontamination": decontam.OP6_SQL,
    "op12_mixing": mixing.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
