"""The library's operators applied to the supplied tables, each with its SQL counterpart where there is one."""

from workloads import corpus, indexes, relational, rows, sampling, scalars, statistics, storage, topics, vectors  # noqa: F401
from workloads.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
