"""All queries over the given tables, and their SQL."""

from postmill.plans import feed_queries, filter_queries, listing_queries, market_queries, profile_queries, score_queries, store_queries, stream_queries  # noqa: F401
from postmill.plans.derived import ORACLE_SQL, QUERIES  # noqa: F401
