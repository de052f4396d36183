"""All queries of the core, with the SQL that states the same result."""

from __future__ import annotations

from . import advanced, consensus, further, graph, keyed, kmers, relational, scalar, stored, text

MODULES = (keyed, scalar, kmers, relational, graph, advanced, consensus, text, further, stored)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
FLAGSHIP = "agg01_kmer_count"
