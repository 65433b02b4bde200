"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

from . import calibration, catalogue, communities, decisions, effects, evidence, files, graphs, information, precision, reports, scalars, streams, studies, tails
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "calibration", "catalogue", "communities", "decisions", "effects", "evidence", "files", "graphs", "information", "reports", "scalars", "streams", "studies", "tails"]
