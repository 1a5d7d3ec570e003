"""Registered queries and their SQL."""

from __future__ import annotations

from . import documents, fields, media, recorded, relations, reporting

QUERIES = {**documents.QUERIES, **fields.QUERIES, **relations.QUERIES, **reporting.QUERIES, **media.QUERIES, **recorded.QUERIES}
ORACLE_SQL = {**documents.SQL, **fields.SQL, **relations.SQL, **reporting.SQL, **media.SQL, **recorded.SQL}
