"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from idloom.llm import chunk_dedup, exact_dedup, language, near_dedup, packing, pieces, pii, quality, spelling, token_files, toxicity, tree_packing, whitening

_MODULES = (exact_dedup, pieces, language, toxicity, packing, pii, chunk_dedup, token_files, quality, near_dedup, tree_packing, whitening, spelling)
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
