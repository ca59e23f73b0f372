"""All registered queries of the retrieval and scoring operators, and their SQL."""

from __future__ import annotations

from askloom.plans import candidate_queries, frame_queries, hook_queries, relational_queries, retrieval_queries, scoring_queries, table_queries, training_queries

PARTS = (scoring_queries, retrieval_queries, candidate_queries, table_queries, training_queries, hook_queries, frame_queries, relational_queries)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
