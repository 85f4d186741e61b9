"""All queries of the library but those of the training-data operators."""

from __future__ import annotations

from curatrix.plans import decided, defective, filtered, findings, kernels, labelled, reported, runs, scores, stored, summarized, timed, vectors  # noqa: F401
from curatrix.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
