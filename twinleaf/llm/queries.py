"""Registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from .bpe import op2_bpe
from .html_text import op6_html
from .langid import op5_langid
from .packing import op8_packing
from .phrases import op7_phrases
from .quality import OP9_SQL, op9_quality
from .sharding import OP1_SQL, op1_sharding
from .simhash import op4_simhash
from .token_counts import op10_token_counts
from .token_store import op3_token_store


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    return {f.__name__: f for f in (op1_sharding, op2_bpe, op3_token_store, op4_simhash, op5_langid, op6_html, op7_phrases, op8_packing, op9_quality, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL, where SQL can express the query."""
    return {"op1_sharding": OP1_SQL, "op9_quality": OP9_SQL}
