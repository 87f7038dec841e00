"""All registered queries."""

from quire.plans import inputs  # noqa: F401
from quire.plans import text_queries  # noqa: F401
from quire.plans import structure_queries  # noqa: F401
from quire.plans import retrieval_queries  # noqa: F401
from quire.plans import grounding_queries  # noqa: F401
from quire.plans import package_queries  # noqa: F401
from quire.plans import practice_queries  # noqa: F401
from quire.plans import document_queries  # noqa: F401
from quire.plans import source_queries  # noqa: F401
from quire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
