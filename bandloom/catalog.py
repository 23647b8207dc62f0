"""All registered queries of the library with their SQL."""

from __future__ import annotations

import importlib

from .registry import QUERIES, SQL, Query

FLAGSHIP = "ag6_path_gap"
_PLANS = ("bands", "keys", "metrics", "splits", "joins", "quality", "geometry", "topk", "figures", "incremental", "features", "contracts", "reports")


def _load() -> None:
    for name in _PLANS:
        importlib.import_module(f"bandloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
