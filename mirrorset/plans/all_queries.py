"""Imports every module that registers queries."""

from mirrorset.plans import (  # noqa: F401
    catalog_queries,
    clip_queries,
    flow_queries,
    matching_queries,
    result_queries,
)  # noqa: F401
from mirrorset.plans.registry import ORACLES, QUERIES  # noqa: F401
