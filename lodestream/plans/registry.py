"""Every query of the library and the SQL that it is held against."""

from __future__ import annotations

from lodestream.plans import compositions, detection_queries, feature_queries, feed_queries, mechanism_queries, rule_searches, search_queries, telemetry_queries, tracker_queries  # noqa: F401  they register their queries
from lodestream.plans.catalog import QUERIES, SQL, Query

FLAGSHIP = "distinct_window"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
