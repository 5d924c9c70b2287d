"""Every registered query, gathered from the query modules."""

from . import daily_queries, ingest_queries, matching_queries, quality_queries, registry_queries, report_queries, review_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
