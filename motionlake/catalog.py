"""All registered queries of the motion operators, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

PLAN_MODULES = ("series", "joins", "sessions", "poses", "metric_blocks", "stroke_metrics", "tracking", "inout", "streams", "strokes", "jobs", "records")
FLAGSHIP = "cj3_session_summary"


def _collected(name: str) -> dict:
    out: dict = {}
    for module in PLAN_MODULES:
        found = getattr(import_module(f"{__package__}.plans.{module}"), name)
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict[str, Callable]:
    return _collected("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collected("ORACLE_SQL")


def flagship(spark, sf_dir: str):
    return queries()[FLAGSHIP](spark, sf_dir)
