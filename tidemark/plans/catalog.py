"""All registered queries of the engine; importing the plan modules fills the register."""

from __future__ import annotations

from tidemark.plans import alarms, contract_queries, models, spectral_queries, stage_queries, stream_queries, tables, trial_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
