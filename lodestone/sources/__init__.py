"""Readers: fixed-width atom records, molecule files, fragment lists, tables, caches."""
