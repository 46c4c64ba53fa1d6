"""All queries on the driver's tables, with the SQL that checks them."""

from codeatlas.plans import code_queries, table_queries

QUERIES = code_queries.QUERIES | table_queries.QUERIES
ORACLE = code_queries.ORACLE | table_queries.ORACLE
