"""Imports the modules that register queries."""

from __future__ import annotations

from . import box_queries, evaluation_queries, geometry_queries, point_queries, result_queries, scene_queries, text_queries, view_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
