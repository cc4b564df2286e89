"""The query catalogue: every registered query with its SQL twin."""

from __future__ import annotations

from treeline.catalogue import audits, corpus, evidence, graph, portfolio, proofs, scopes, stores

PARTS = (graph, corpus, audits, evidence, portfolio, proofs, scopes, stores)


def queries() -> dict:
    return {name: q for part in PARTS for name, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
