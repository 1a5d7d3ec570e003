"""The registry of this subpackage: query name to function, and SQL."""

from __future__ import annotations

from . import oracles
from .langid import op7_language_id
from .lines import op3_line_classes, op3_line_dedup
from .media import op1_media_columns
from .neardup import op4_minhash
from .packing import op9_packing
from .pieces import op6_sentencepiece
from .quality import op5_quality_rules
from .sharding import op10_sharding
from .suffixes import op2_suffix_dedup
from .urls import op8_url_filters

QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op3_line_classes": op3_line_classes,
    "op4_minhash": op4_minhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language_id": op7_language_id,
    "op8_url_filters": op8_url_filters,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL = {
    "op5_quality_rules": oracles.op5_sql(),
    "op8_url_filters": oracles.op8_sql(),
}
