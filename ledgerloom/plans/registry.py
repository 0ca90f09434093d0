"""Registered queries of the reconciliation operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import q_audit, q_match, q_report, q_stream, q_triage, q_validate
from ledgerloom.plans.q_report import flagship

MODULES = (q_validate, q_match, q_triage, q_report, q_audit, q_stream)
__all__ = ["flagship", "queries", "oracle_sql"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.Q.items() if sql}
