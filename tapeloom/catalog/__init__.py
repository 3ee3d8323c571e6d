"""All registered queries, grouped by operator family."""

from importlib import import_module

from tapeloom.catalog import base

_FAMILIES = ("scalars", "windows", "joins", "aggregates", "selections", "sources", "streams", "models")


def _load():
    for family in _FAMILIES:
        import_module(f"tapeloom.catalog.{family}")


def queries():
    _load()
    return dict(base.QUERIES)


def oracle_sql():
    _load()
    return dict(base.ORACLES)
