"""Every operator as a named query on the benchmark tables, with its SQL check."""

from posigauge.catalog.base import QUERIES, SQL

from posigauge.catalog import plan_queries  # noqa: E402,F401
from posigauge.catalog import relation_queries  # noqa: E402,F401
from posigauge.catalog import scalar_queries  # noqa: E402,F401
from posigauge.catalog import source_queries  # noqa: E402,F401
from posigauge.catalog import stats_queries  # noqa: E402,F401

__all__ = ["QUERIES", "SQL"]
