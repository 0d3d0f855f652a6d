"""All registered queries; importing this module fills the registry."""

from offerlens.plans import catalog_queries, history_queries, identity_queries, portfolio_queries, resolution_queries, search_queries, source_queries, streaming_queries  # noqa: F401
from offerlens.plans.registry import ORACLES, QUERIES  # noqa: F401
