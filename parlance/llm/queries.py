"""Registered queries of the training-data operators and, where SQL can express them, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm.ann import op9_learned_partitions
from parlance.llm.bpe import op3_bpe_automaton
from parlance.llm.collocations import op12_collocations
from parlance.llm.collocations import oracle_sql as collocations_sql
from parlance.llm.embedding_dedup import op6_embedding_dedup
from parlance.llm.html_extract import op11_html_text
from parlance.llm.license_scan import op4_license_scan
from parlance.llm.license_scan import oracle_sql as license_sql
from parlance.llm.lines import op1_line_dedup
from parlance.llm.packing import op7_curve_packing
from parlance.llm.periodic import op13_periodic_runs
from parlance.llm.quality import op2_quality_classifier
from parlance.llm.simhash import op8_simhash_near_dedup
from parlance.llm.substrings import op5_recompression_dedup
from parlance.llm.toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_bpe_automaton": op3_bpe_automaton,
    "op4_license_scan": op4_license_scan,
    "op5_recompression_dedup": op5_recompression_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_curve_packing": op7_curve_packing,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_learned_partitions": op9_learned_partitions,
    "op10_toxicity": op10_toxicity,
    "op11_html_text": op11_html_text,
    "op12_collocations": op12_collocations,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE: dict[str, str] = {"op4_license_scan": license_sql(), "op12_collocations": collocations_sql()}
