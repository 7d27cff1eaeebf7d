"""Every query of the engine by name, with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from flowlake.plans import management, scalars, tracks

PARTS = (tracks, management, scalars)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
