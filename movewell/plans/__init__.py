"""Registered queries: domain views over the given tables, the queries, their SQL twins."""
