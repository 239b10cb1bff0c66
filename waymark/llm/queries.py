"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunks, collocations, language, leaks, licences, pages, pieces, quality, shards, simhash, spelling, tokens, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_latent_leaks": leaks.op1_latent_leaks,
    "op2_token_files": tokens.op2_token_files,
    "op3_tree_scoring": pages.op3_tree_scoring,
    "op4_licence_digests": licences.op4_licence_digests,
    "op5_chunk_dedup": chunks.op5_chunk_dedup,
    "op6_hash_tree_shards": shards.op6_hash_tree_shards,
    "op7_language_spans": language.op7_language_spans,
    "op8_simhash_components": simhash.op8_simhash_components,
    "op9_compression_bands": quality.op9_compression_bands,
    "op10_piece_codec": pieces.op10_piece_codec,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_collocations": collocations.op12_collocations,
    "op13_rotated_codes": vectors.op13_rotated_codes,
}

ORACLE_SQL: dict[str, str] = {"op4_licence_digests": licences.SQL, "op11_spelling_variants": spelling.SQL, "op12_collocations": collocations.SQL, "op13_rotated_codes": vectors.SQL}
