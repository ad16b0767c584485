"""Registered queries of the training-data operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from vinegrid.llm.bpe import op12_bpe
from vinegrid.llm.embeddings import OP4_SQL, op4_embedding_dedup
from vinegrid.llm.hamming import OP10_SQL, op10_top_k
from vinegrid.llm.language import op8_language_id
from vinegrid.llm.merkle import OP13_SQL, op13_merkle
from vinegrid.llm.packing import op2_packing
from vinegrid.llm.paragraphs import op5_substring_dedup
from vinegrid.llm.resampling import OP11_SQL, op11_resampling
from vinegrid.llm.segmentation import op9_sentencepiece
from vinegrid.llm.sharding import op3_sharding
from vinegrid.llm.simhash import op6_simhash
from vinegrid.llm.suffix import op7_suffix_dedup
from vinegrid.llm.urls import op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_sharding": op3_sharding,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash": op6_simhash,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_id": op8_language_id,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_top_k": op10_top_k,
    "op11_resampling": op11_resampling,
    "op12_bpe": op12_bpe,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {"op4_embedding_dedup": OP4_SQL, "op10_top_k": OP10_SQL, "op11_resampling": OP11_SQL, "op13_merkle": OP13_SQL}
