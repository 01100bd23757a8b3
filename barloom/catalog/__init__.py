"""Named queries over the supplied tables, each with the SQL that must give the same rows."""

from barloom.catalog import cleaning, datasets, indicators, jobs, models, reports, sources, streams, symbols  # noqa: F401
from barloom.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
