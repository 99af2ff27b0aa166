"""Queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dagloom.llm import collocations, search
from dagloom.llm.chat import op9_chat_format
from dagloom.llm.codec import op4_id_files
from dagloom.llm.collocations import op13_collocations
from dagloom.llm.decontam import op7_decontaminate
from dagloom.llm.jaccard import op2_ngram_jaccard
from dagloom.llm.langid import op5_language_id, op5_language_id_pages
from dagloom.llm.lm import op1_lm_score
from dagloom.llm.media import op8_telephony
from dagloom.llm.packing import op6_packing
from dagloom.llm.prefix_tokens import op3_prefix_tokens
from dagloom.llm.search import op12_lexical_search
from dagloom.llm.substring import op10_substring_dedup
from dagloom.llm.suffixes import op11_suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    every = (
        op1_lm_score,
        op2_ngram_jaccard,
        op3_prefix_tokens,
        op4_id_files,
        op5_language_id,
        op5_language_id_pages,
        op6_packing,
        op7_decontaminate,
        op8_telephony,
        op9_chat_format,
        op10_substring_dedup,
        op11_suffix_dedup,
        op12_lexical_search,
        op13_collocations,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op12_lexical_search": search.SQL, "op13_collocations": collocations.SQL}
