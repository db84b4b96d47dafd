"""Registered queries and their SQL, by family."""

from . import nested, relational, scoring, texts, trajectories

QUERIES: dict = {}
ORACLE: dict = {}
for _m in (nested, scoring, relational, trajectories, texts):
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
