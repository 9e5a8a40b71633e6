"""Queries and oracle SQL of the library's own operators."""

from tidemill.plans import graph_queries, index_queries, relational_queries, search_queries, temporal_queries, window_queries

QUERIES: dict = search_queries.QUERIES | index_queries.QUERIES | graph_queries.QUERIES | relational_queries.QUERIES | temporal_queries.QUERIES | window_queries.QUERIES
ORACLES: dict = search_queries.ORACLES | index_queries.ORACLES | graph_queries.ORACLES | relational_queries.ORACLES | temporal_queries.ORACLES | window_queries.ORACLES
