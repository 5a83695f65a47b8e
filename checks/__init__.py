"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from checks.registry import ORACLES, QUERIES
from checks import dataset, detections, evaluation, grids, plans, reporting, splits, weather  # noqa: F401
