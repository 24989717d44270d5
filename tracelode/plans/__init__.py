"""Registered queries over the test tables, each with its SQL where SQL can say the same."""

from tracelode.plans import growth, ledger, logs, lookups, phrases, profiles, relations, sequences, streams, texts, usages, workspace  # noqa: F401
from tracelode.plans.base import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
