"""The registered queries: every operator over the given tables.

Each module holds ``QUERIES`` (name to function of session and folder) and
``ORACLE`` (name to the SQL that must give the same rows).
"""

from stockweave.queries import catalog, chat, search, streams, tables, texts

MODULES = (catalog, texts, search, tables, chat, streams)


def all_queries():
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_oracles():
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
