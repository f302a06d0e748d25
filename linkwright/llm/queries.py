"""The queries of this subpackage and the SQL that some of them match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .alignment import op13_token_alignment
from .bpe import op9_bpe
from .chat import op6_chat_format
from .compaction import op11_compaction
from .jaccard import op10_jaccard_join
from .language_id import op1_language_id
from .lines import op12_line_dedup
from .lm import op4_lm_score
from .mixing import op5_mixing
from .phrases import op8_phrase_dedup
from .suffix_dedup import op3_suffix_dedup
from .vectors import op2_embedding_join, op7_top_k


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_embedding_join, op3_suffix_dedup, op4_lm_score, op5_mixing, op6_chat_format, op7_top_k, op8_phrase_dedup, op9_bpe, op10_jaccard_join, op11_compaction, op12_line_dedup, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_join": sql.EMBEDDING_JOIN, "op3_suffix_dedup": sql.SUFFIX_DEDUP, "op5_mixing": sql.MIXING, "op7_top_k": sql.TOP_K, "op8_phrase_dedup": sql.PHRASE_DEDUP,
        "op10_jaccard_join": sql.JACCARD_JOIN, "op12_line_dedup": sql.LINE_DEDUP,
    }
