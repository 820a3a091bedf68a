"""Catalogue of registered queries and their SQL."""

from fringeline.plans import correlation, files, signals, sql

QUERIES = correlation.QUERIES | signals.QUERIES | files.QUERIES | sql.QUERIES
ORACLE_SQL = correlation.ORACLE_SQL | signals.ORACLE_SQL | files.ORACLE_SQL | sql.ORACLE_SQL
