"""Registered queries and their oracle SQL, by group."""

from siltstone.plans import chunks, lifecycles, relations, scalars, search, streams

GROUPS = (chunks, search, relations, scalars, lifecycles, streams)
QUERIES: dict = {name: q for group in GROUPS for name, q in group.QUERIES.items()}
ORACLES: dict = {name: sql for group in GROUPS for name, sql in group.ORACLES.items()}
