"""Relational operators: spatial joins, profiling, ranking, skylines, clustering, enrichment, search."""
