"""Queries over the driver's tables."""

from quillstone.plans import files, flagship, scores, spaces, streams, texts, wide  # noqa: F401
from quillstone.plans.registry import ORACLE, QUERIES  # noqa: F401
