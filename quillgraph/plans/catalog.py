"""All queries over the driver's tables: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from quillgraph.plans import bundles, construction, graphs, reports, reviews, storage, texts

QUERIES = {**reports.QUERIES, **graphs.QUERIES, **texts.QUERIES, **construction.QUERIES, **reviews.QUERIES, **bundles.QUERIES, **storage.QUERIES}
