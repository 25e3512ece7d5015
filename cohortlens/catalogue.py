"""All registered queries of the reference's operators with their SQL."""

from __future__ import annotations

from cohortlens.plans import cohorts, consenting, evidencing, landing, linking, measuring, merging, scoring, sequences  # noqa: F401
from cohortlens.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "a04_agreement_metrics"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
