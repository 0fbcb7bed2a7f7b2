"""All queries over the driver tables: name -> function of (spark, sf_dir), and their SQL twins."""

from __future__ import annotations

from .plans import ledger, materials, signals, structures

_PLANS = (structures, materials, signals, ledger)
QUERIES = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in _PLANS for k, v in p.ORACLES.items()}
