"""All queries of the core, with the SQL that gives the same rows."""

from tilewright.queries import archives, geometries, grid, more, upkeep

MODULES = [upkeep, grid, archives, more, geometries]


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
