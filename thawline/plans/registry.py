"""Query name -> callable and SQL twin, for every operator outside the training-data subpackage."""

from __future__ import annotations

from . import base


def _load() -> None:
    from . import accuracy, content, equity, ingest, modelling, synthetic  # noqa: F401  each registers its queries


_load()
QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
