"""Registered queries of the training-data operators, with their check SQL."""

from reelshelf.llm import (
    bpe,
    conversation_repair,
    embedding_dedup,
    exact_dedup,
    language_id,
    lexical_search,
    packing,
    quality,
    simhash,
    source_mixing,
    token_counts,
    toxicity,
    warc,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_simhash": simhash.op3_simhash,
    "op4_packing": packing.op4_packing,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_bpe_codec": bpe.op7_bpe_codec,
    "op8_quality": quality.op8_quality,
    "op9_warc": warc.op9_warc,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_source_mix": source_mixing.op12_source_mix,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLES = {
    "op9_warc": warc.OP9_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_conversation_repair": conversation_repair.OP11_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
