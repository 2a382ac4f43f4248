"""Imports every catalog module so the registry is filled."""

from __future__ import annotations

from . import catalog_fixes, catalog_models, catalog_profile  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
