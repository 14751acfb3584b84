"""Queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, collocations, exact_dedup, language_id, line_dedup, packing, quality, sentence_pieces, simhash, super_minhash, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentence_pieces": sentence_pieces.op1_sentence_pieces,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_language_id": language_id.op3_language_id,
        "op4_nearest_neighbours": ann.op4_nearest_neighbours,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_simhash": simhash.op6_simhash,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_quality": quality.op8_quality,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_super_minhash": super_minhash.op11_super_minhash,
        "op12_collocations": collocations.op12_collocations,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a result; the other queries are tested against brute force in tests/llm."""
    return {"op10_exact_dedup": exact_dedup.OP10_SQL, "op12_collocations": collocations.OP12_SQL}
