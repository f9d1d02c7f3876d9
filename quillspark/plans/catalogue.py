"""All queries of the engine itself."""

from . import consistency_queries, entity_queries, file_queries, ingest_queries, quality_queries, report_queries, typography_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES  # noqa: F401
