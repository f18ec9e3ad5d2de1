"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from kelpforge.llm import bpe, collocations, embeddings, jaccard, jpeg, mixing, packing, pii, quality, sharding, token_files, vector_codes, warc
from kelpforge.llm.oracles import ORACLE_SQL

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_progressive_jpeg": jpeg.op2_progressive_jpeg,
    "op3_embedding_copies": embeddings.op3_embedding_copies,
    "op4_token_files": token_files.op4_token_files,
    "op5_pii": pii.op5_pii,
    "op6_warc": warc.op6_warc,
    "op7_quality": quality.op7_quality,
    "op8_mixing": mixing.op8_mixing,
    "op9_bpe": bpe.op9_bpe,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_collocations": collocations.op11_collocations,
    "op12_packing": packing.op12_packing,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
