"""Named queries: every operator on the given tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from simloom.catalog.registry import ORACLES, QUERIES
from simloom.catalog import (  # noqa: F401  (modules register their queries on import)
    alignments,
    graphs,
    metadata,
    networks,
    outputs,
    pairs,
    selections,
    sequences,
    trees,
)

__all__ = ["ORACLES", "QUERIES"]
