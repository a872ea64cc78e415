"""Registered queries by name, and their SQL."""

from . import advice, brackets, checks, fixes, full, history, imports, ingest, lookaround, planning, prompts, scanning

_MODULES = (history, scanning, lookaround, planning, ingest, checks, prompts, advice, brackets, full, imports, fixes)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
