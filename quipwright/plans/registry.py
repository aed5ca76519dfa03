"""All core queries with their oracle SQL, gathered from the modules of this package."""

from __future__ import annotations

from quipwright.plans import corpus, drift, feedback, labels, scores, statistics, vectors

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (corpus, labels, scores, statistics, vectors, feedback, drift):
    QUERIES |= _module.P.queries
    ORACLES |= _module.P.oracles
