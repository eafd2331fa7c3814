"""All registered queries, their SQL, and the operators that each covers."""

from __future__ import annotations

from retrievo.plans import figures, files, learned, ranked

MODULES = (ranked, figures, learned, files)


def _all() -> dict:
    return {name: entry for module in MODULES for name, entry in module.QUERIES.items()}


def queries() -> dict:
    return {name: fn for name, (fn, _, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql, _) in _all().items() if sql}


def coverage() -> dict[str, list[str]]:
    """Operator -> the queries that use it."""
    found: dict[str, list[str]] = {}
    for name, (_, _, ops) in _all().items():
        for op in ops.split():
            found.setdefault(op, []).append(name)
    return found
