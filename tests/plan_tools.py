"""Helpers of the plan tests; a module of its own, as several folders have a conftest."""

from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
