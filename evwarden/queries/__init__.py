"""Registered queries over the supplied tables, each with SQL that must give the same rows."""

from evwarden.queries import logs, sequences, streams, workloads
from evwarden.queries.tables import Query

MODULES = (sequences, logs, workloads, streams)
QUERIES: dict[str, Query] = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
