"""All queries of the core, by name, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from ..operators import units
from . import access, bibliography, checks, corpus, graph, measures, mentions, navigation, quality, relational, search, storage, temporal, text, vectors

MODULES = [relational, text, vectors, graph, temporal, quality, corpus, storage, bibliography, measures, access, checks, navigation, search, mentions, units]


def queries() -> dict[str, Callable]:
    found = {name: run for m in MODULES for name, run in m.QUERIES.items()}
    if len(found) < sum(len(m.QUERIES) for m in MODULES):
        raise ValueError("two queries have one name")
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
