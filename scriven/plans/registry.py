"""Every query of the engine by name, with its SQL twin for DuckDB where one exists."""

from __future__ import annotations

from . import checks, folds, intervals, meetings, minutes, more, reports, rules, scalars, terms, text  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
