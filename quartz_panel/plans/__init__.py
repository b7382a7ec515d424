"""All queries of the panel library and their SQL."""

import importlib

MODULES = ("factor_queries", "evaluation_queries", "service_queries", "walk_queries", "stream_queries", "intake_queries", "panel_queries", "production_queries")


def _load():
    from . import registry

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return registry


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_load().ORACLES)
