"""Queries over the driver tables, each with the SQL that checks it."""

from . import comparisons, listings, overlays, plans_views, scalars  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
