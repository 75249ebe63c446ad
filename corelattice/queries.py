"""Registry of the queries of the core."""

from __future__ import annotations

from corelattice import cell_queries, graph_queries, image_queries, proximity_queries, stats_queries

_PARTS = (proximity_queries, cell_queries, graph_queries, stats_queries, image_queries)
QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
FLAGSHIP = "category_props"
