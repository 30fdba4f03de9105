"""The registered queries of the llm operators and their DuckDB SQL."""

from __future__ import annotations

from veracity.llm import (bpe, embeddings, langid, minhash, packing, pieces, quality, recompress, sharding, spelling,
                          toxicity, treap, warc)

QUERIES = {
    "op1_substring_dedup": recompress.op1_substring_dedup,
    "op2_warc": warc.op2_warc,
    "op3_toxicity": toxicity.op3_toxicity,
    "op7_embedding_near_duplicates": embeddings.op7_embedding_near_duplicates,
    "op8_quality_rules": quality.op8_quality_rules,
    "op4_extendible_shards": sharding.op4_extendible_shards,
    "op5_minhash_near_duplicates": minhash.op5_minhash_near_duplicates,
    "op6_language_id": langid.op6_language_id,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_lexical_search": treap.op13_lexical_search,
}

ORACLE = {
    "op2_warc": warc.ORACLE_SQL,
    "op4_extendible_shards": sharding.ORACLE_SQL,
    "op13_lexical_search": treap.ORACLE_SQL,
}
