"""The queries of this subpackage and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from quarry.llm.html import op1_html_extraction
from quarry.llm.mixing import op4_mixing
from quarry.llm.oracles import ORACLE_SQL
from quarry.llm.packing import op10_packing
from quarry.llm.quality import op7_quality_rules
from quarry.llm.sharding import op6_sharding
from quarry.llm.simhash import op9_simhash_near_dedup
from quarry.llm.substring import op5_substring_dedup
from quarry.llm.toxicity import op2_toxicity
from quarry.llm.urls import op8_url_filters
from quarry.llm.vectors import op3_embedding_near_dedup

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_toxicity,
        op3_embedding_near_dedup,
        op4_mixing,
        op5_substring_dedup,
        op6_sharding,
        op7_quality_rules,
        op8_url_filters,
        op9_simhash_near_dedup,
        op10_packing,
    )
}
