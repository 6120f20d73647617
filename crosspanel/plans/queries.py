"""All registered queries: importing the modules registers them."""

from crosspanel.plans import extra_queries, metric_queries, panel_queries, portfolio_queries, signal_queries, source_queries, strategy_queries  # noqa: F401
from crosspanel.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
