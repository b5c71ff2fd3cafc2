"""Registered queries of the engine and their SQL twins."""

from . import core, extra, molecules, named, science  # noqa: F401
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
