"""Registered queries over the driver's tables, each with its DuckDB twin where SQL can say it."""

from checks import scalars, cleaning, shape, sheets, runs, inference, files
from checks.registry import ORACLES, QUERIES
