"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clicktide.llm.classifier import op13_quality
from clicktide.llm.embeddings import OP1_SQL, op1_embeddings
from clicktide.llm.licenses import OP10_SQL, op10_licenses
from clicktide.llm.mixing import OP9_SQL, op9_mix
from clicktide.llm.packing import op5_pack
from clicktide.llm.pages import op8_html
from clicktide.llm.quality import OP3_SQL, op3_quality
from clicktide.llm.search import OP11_SQL, op11_search
from clicktide.llm.simhash import op2_simhash
from clicktide.llm.substrings import OP6_SQL, op6_substrings
from clicktide.llm.tokens import op4_token_counts
from clicktide.llm.toxicity import op7_toxicity
from clicktide.llm.whitening import op12_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_embeddings, op2_simhash, op3_quality, op4_token_counts, op5_pack,
        op6_substrings, op7_toxicity, op8_html, op9_mix, op10_licenses,
        op11_search, op12_whitening, op13_quality,
    ]
    return {q.__name__: q for q in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embeddings": OP1_SQL,
        "op3_quality": OP3_SQL,
        "op6_substrings": OP6_SQL,
        "op9_mix": OP9_SQL,
        "op10_licenses": OP10_SQL,
        "op11_search": OP11_SQL,
    }
