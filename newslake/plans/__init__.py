"""Registered queries: importing this package fills ``QUERIES`` and ``ORACLES``."""

from newslake.plans import aggregates, catalog, events, ingest, pipeline, relational, scalars, search, store  # noqa: F401
from newslake.plans.registry import ORACLES, QUERIES  # noqa: F401
