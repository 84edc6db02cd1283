"""Queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quakeloom.llm import decontaminate, jaccard_join, line_quality, repeats, spelling
from quakeloom.llm.bottom_k import op6_bottom_k
from quakeloom.llm.decontaminate import op5_decontaminate
from quakeloom.llm.histogram_shards import op1_histogram_shards
from quakeloom.llm.jaccard_join import op10_jaccard_join
from quakeloom.llm.licenses import op8_licenses
from quakeloom.llm.line_quality import op12_line_quality
from quakeloom.llm.mixing import op7_mixing
from quakeloom.llm.repeats import op3_repeats
from quakeloom.llm.secrets import op9_secrets
from quakeloom.llm.spelling import op13_spelling
from quakeloom.llm.token_files import op2_token_files
from quakeloom.llm.toxicity import op4_toxicity
from quakeloom.llm.whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_histogram_shards": op1_histogram_shards,
    "op2_token_files": op2_token_files,
    "op3_repeats": op3_repeats,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_bottom_k": op6_bottom_k,
    "op7_mixing": op7_mixing,
    "op8_licenses": op8_licenses,
    "op9_secrets": op9_secrets,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_whitening": op11_whitening,
    "op12_line_quality": op12_line_quality,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op3_repeats": repeats.ORACLE_SQL,
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op10_jaccard_join": jaccard_join.ORACLE_SQL,
    "op12_line_quality": line_quality.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
