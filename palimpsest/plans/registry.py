"""All registered queries: name to builder, and name to SQL where SQL can say it."""

from __future__ import annotations

from . import dataset_queries, episode_queries, fold_queries, learned_queries, ledger_queries, metric_queries, read_queries, retrieval_queries, rule_queries, text_queries

_PARTS = (text_queries, ledger_queries, retrieval_queries, metric_queries, dataset_queries, learned_queries, episode_queries, read_queries, rule_queries, fold_queries)
QUERIES = {name: build for part in _PARTS for name, build in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
