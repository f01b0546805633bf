"""Queries over the generated tables, one or more for each operator, and the SQL they are held against."""

from __future__ import annotations

from kilnwork.plans import curation, linking, pages, records, search, workflow

QUERIES: dict = {**linking.QUERIES, **search.QUERIES, **pages.QUERIES, **curation.QUERIES, **records.QUERIES, **workflow.QUERIES}
ORACLE_SQL: dict = {**linking.ORACLE_SQL, **search.ORACLE_SQL, **pages.ORACLE_SQL, **curation.ORACLE_SQL, **records.ORACLE_SQL, **workflow.ORACLE_SQL}
