"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from postmill.llm import chat, decontamination, lexical, mixing, negatives, neighbours, pii, quality, repetition, secrets, sharding, simhash, warc

QUERIES = {
    f.__name__: f
    for f in (
        decontamination.op1_decontamination, quality.op2_quality_pu, pii.op3_pii_weak_labels, simhash.op4_simhash_bktree,
        sharding.op5_stratified_shards, repetition.op6_repetition_rules, warc.op7_warc_index, secrets.op8_secret_markov,
        mixing.op9_mix_to_weights, chat.op10_chat_format, negatives.op11_hard_negatives, neighbours.op12_projected_neighbours, lexical.op13_hybrid_search,
    )
}

ORACLE_SQL = {k: v for m in (decontamination, repetition, warc, mixing, chat, negatives, lexical) for k, v in m.ORACLE.items()}
