"""Collects a module's queries and the SQL that checks them."""

from __future__ import annotations


def catalog():
    """A decorator that registers a query under its name, and the two dictionaries it fills."""
    queries, oracle = {}, {}

    def query(sql: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return register

    return query, queries, oracle
