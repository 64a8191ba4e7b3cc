"""All registered queries and their SQL."""
import importlib

from .registry import ORACLES, QUERIES

MODULES = ("scalars", "sheets", "mails", "files", "people", "envelopes", "forms", "mapped", "jobs", "streams")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)
