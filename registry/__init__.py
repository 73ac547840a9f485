"""Queries that the driver checks, each with its SQL where SQL can express it."""

from __future__ import annotations

from registry import (
    evaluation,
    features,
    indexing,
    news,
    reporting,
    retrieval,
    verification,
)

FAMILIES = [news, retrieval, verification, evaluation, indexing, reporting, features]


def queries():
    return {k: v for family in FAMILIES for k, v in family.QUERIES.items()}


def oracles():
    return {k: v for family in FAMILIES for k, v in family.SQL.items()}
