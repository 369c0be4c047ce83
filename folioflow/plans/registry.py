"""All queries of the engine: name -> (function of session and folder, SQL or None)."""

from __future__ import annotations

from . import documents, exports, rasters, repair, scalars, usage, words

FAMILIES = (scalars, repair, documents, usage, words, rasters, exports)
ALL = {name: pair for family in FAMILIES for name, pair in family.QUERIES.items()}
QUERIES = {name: run for name, (run, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
