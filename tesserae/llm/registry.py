"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.byte_bpe import op2_byte_bpe
from tesserae.llm.embeddings import op4_embedding_dedup
from tesserae.llm.filter_audit import OP13_SQL, op13_filter_audit
from tesserae.llm.fingerprints import op12_fingerprints
from tesserae.llm.html_text import op5_html_text
from tesserae.llm.minhash import op9_minhash
from tesserae.llm.mixing import OP7_SQL, op7_mixing
from tesserae.llm.quality import op8_quality
from tesserae.llm.source_divergence import OP11_SQL, op11_source_divergence
from tesserae.llm.substring_dedup import op1_substring_dedup
from tesserae.llm.token_files import op10_token_files
from tesserae.llm.toxicity import op6_toxicity
from tesserae.llm.word_tokens import op3_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_token_counts": op3_token_counts,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_html_text": op5_html_text,
        "op6_toxicity": op6_toxicity,
        "op7_mixing": op7_mixing,
        "op8_quality": op8_quality,
        "op9_minhash": op9_minhash,
        "op10_token_files": op10_token_files,
        "op11_source_divergence": op11_source_divergence,
        "op12_fingerprints": op12_fingerprints,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": OP7_SQL, "op11_source_divergence": OP11_SQL, "op13_filter_audit": OP13_SQL}
