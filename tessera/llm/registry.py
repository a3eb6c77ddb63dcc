"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontamination import op1_decontamination
from tessera.llm.fingerprints import op8_fingerprints
from tessera.llm.jaccard import op5_jaccard_join
from tessera.llm.language import op2_language_id
from tessera.llm.linkgraph import LINKS_SQL, op11_link_graph
from tessera.llm.mixing import op10_mixing
from tessera.llm.quality import op4_quality
from tessera.llm.ranking import RANKS_SQL, op12_max_tree_search
from tessera.llm.secrets import op7_secret_scan
from tessera.llm.sharding import SHARDS_SQL, op3_byte_shards
from tessera.llm.tokens import op6_token_counts
from tessera.llm.toxicity import op9_toxicity
from tessera.llm.vafile import CODES_SQL, op13_va_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontamination": op1_decontamination, "op2_language_id": op2_language_id, "op3_byte_shards": op3_byte_shards, "op4_quality": op4_quality, "op5_jaccard_join": op5_jaccard_join, "op6_token_counts": op6_token_counts, "op7_secret_scan": op7_secret_scan, "op8_fingerprints": op8_fingerprints, "op9_toxicity": op9_toxicity, "op10_mixing": op10_mixing, "op11_link_graph": op11_link_graph, "op12_max_tree_search": op12_max_tree_search, "op13_va_codes": op13_va_codes}


def oracle_sql() -> dict[str, str]:
    return {"op3_byte_shards": SHARDS_SQL, "op11_link_graph": LINKS_SQL, "op12_max_tree_search": RANKS_SQL, "op13_va_codes": CODES_SQL}
