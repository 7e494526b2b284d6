"""All registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from .plans import catalogue, files_and_edits, perception  # noqa: F401  the others register further queries with the first


def queries() -> dict:
    return catalogue.QUERIES


def oracle_sql() -> dict:
    return catalogue.ORACLE
