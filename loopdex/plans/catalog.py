"""Registry of named plans: name -> Spark callable (spark, sf_dir) and DuckDB oracle SQL."""

from __future__ import annotations

from loopdex.plans import enrich_plans as EP
from loopdex.plans import ingest_plans as IP
from loopdex.plans import misc_plans as MP
from loopdex.plans import text_plans as TP
from loopdex.plans import vector_plans as VP
from loopdex.plans import stream_plans as STP
from loopdex.plans import oracle_search as OS
from loopdex.plans import search_plans as SP
from loopdex.plans import source_plans as SRC

QUERIES = {
    "hybrid_search": SP.hybrid_search,
    "search_totals": SP.search_totals,
}
ORACLE = {
    "hybrid_search": OS.hybrid_search_sql(),
    "search_totals": OS.search_totals_sql(),
}

for _mod in (IP, SRC, EP, MP, SP, TP, VP, STP):
    QUERIES.update(_mod.Q)
    ORACLE.update(_mod.O)
