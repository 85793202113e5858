"""Registered queries: each module holds QUERIES (Spark) and ORACLE (SQL) by name."""
