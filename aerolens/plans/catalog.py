"""All registered queries (imports the query modules for their side effect)."""

from __future__ import annotations

from aerolens.plans import q_layers, q_eval, q_segments, q_curves, q_ingest, q_models, q_stream, q_inject, q_sinks, q_primitives, q_sketches  # noqa: F401
from aerolens.plans.registry import ORACLE, QUERIES


def flagship(spark, sf_dir):
    """Entry query: L1 + L2 detection summarised per flight."""
    return QUERIES["a6_alert_counts"](spark, sf_dir)


__all__ = ["QUERIES", "ORACLE", "flagship"]
