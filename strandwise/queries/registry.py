"""Queries over the derived fixtures, by name, each with the SQL that gives the same rows."""

from . import coding, comparing, design, editing, making, more, sites, workspace

_MODULES = (sites, design, editing, workspace, more, comparing, making, coding)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
