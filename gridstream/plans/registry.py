"""All registered queries of the measurement platform."""

from __future__ import annotations

from gridstream.plans import aggregates, episodes, qualification, sessions, streams

MODULES = [qualification, aggregates, episodes, sessions, streams]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
