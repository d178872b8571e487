"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op1_decontaminate
from .divergence import divergence_sql, op12_source_divergence
from .embedding_dedup import op5_embedding_dedup
from .jaccard_join import op10_jaccard_join
from .language_id import op9_language_id
from .license_scan import op4_license_scan
from .line_dedup import line_sql, op11_line_dedup
from .mixing import mix_sql, op3_mix_sources
from .personal_data import op7_personal_data
from .quality import op8_quality
from .spelling import op13_spelling_variants
from .substring_dedup import op6_substring_dedup
from .suffix_dedup import op2_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_license_scan": op4_license_scan,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_personal_data": op7_personal_data,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_line_dedup": op11_line_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mix_sources": mix_sql(),
    "op11_line_dedup": line_sql(),
    "op12_source_divergence": divergence_sql(),
}
