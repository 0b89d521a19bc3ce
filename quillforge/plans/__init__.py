"""Queries over the stand-in tables; importing this package fills the catalogue."""

from quillforge.plans import curated, selection, states, streams, texts
from quillforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "curated", "selection", "states", "streams", "texts"]
