"""All registered queries of the listings, documents and tax families, with their SQL."""

from __future__ import annotations

from . import curation_queries, document_queries, feed_queries, listing_queries, lookup_queries, search_queries, tax_queries, text_queries

FAMILIES = [listing_queries.R, text_queries.R, tax_queries.R, document_queries.R, feed_queries.R, search_queries.R, curation_queries.R, lookup_queries.R]


def queries() -> dict:
    return {name: f for r in FAMILIES for name, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in FAMILIES for name, sql in r.sql.items()}
