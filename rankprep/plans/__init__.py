"""Registered queries over the driver's tables, and DuckDB SQL of their results."""

from . import evaluation, graphs, preparation, retrieval, sampling, sequences, sources, sparse, splits

MODULES = (sources, preparation, splits, sequences, graphs, sparse, retrieval, sampling, evaluation)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
