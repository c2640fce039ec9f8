"""The queries of this subpackage and the SQL that states them, by name."""

from __future__ import annotations

from .op1_language import op1_language_id
from .op2_lines import op2_line_chunks
from .op10_decontaminate import OP10_SQL, op10_decontaminate
from .op3_quality import op3_quality_rules, op3_sql
from .op4_urls import OP4_SQL, op4_url_filter
from .op5_pack import op5_best_fit_packing
from .op6_surrogates import op6_pii_surrogates
from .op7_counts import op7_token_counts
from .op8_ids import op8_token_ids
from .op9_join import op9_ngram_join

QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_chunks, op3_quality_rules, op4_url_filter, op5_best_fit_packing, op6_pii_surrogates, op7_token_counts, op8_token_ids, op9_ngram_join, op10_decontaminate)}
SQL = {"op3_quality_rules": op3_sql(), "op4_url_filter": OP4_SQL, "op10_decontaminate": OP10_SQL}
