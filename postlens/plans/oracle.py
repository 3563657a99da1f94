"""DuckDB oracle SQL per registered query (where the query is SQL-expressible)."""

from __future__ import annotations


def all_oracles() -> dict[str, str]:
    from postlens.plans.registry import load_all
    load_all()
    from postlens.plans import (queries_core, queries_history, queries_io, queries_items, queries_landed, queries_members,  # noqa: F401
                                queries_raw, queries_rel, queries_scalar, queries_streams)
    out: dict[str, str] = {}
    for mod in (queries_core, queries_scalar, queries_rel, queries_io, queries_items, queries_landed, queries_history,
                queries_raw, queries_streams):
        out.update(mod.ORACLE)
    return out
