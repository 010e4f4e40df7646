"""Registered queries by topic."""

from emberline.queries import evidence, ingest, learning, per_event, places, scoring, stored, streams  # noqa: F401
from emberline.queries.registry import ORACLES, QUERIES  # noqa: F401
