"""All registered queries, by section of the operator inventory."""

from __future__ import annotations

from changerisk.plans import (  # noqa: F401  (importing registers the queries)
    q_evaluation,
    q_features,
    q_graph,
    q_io,
    q_scalar,
    q_streaming,
    q_texts,
)
from changerisk.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
