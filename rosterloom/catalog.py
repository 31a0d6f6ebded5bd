"""All registered queries on the driver's tables, with the SQL that checks them."""

from .plans import activity_queries, contact_queries, delivery_queries, firm_queries, match_queries, place_queries, review_queries, roster_queries, search_queries, stream_queries, summary_queries, territory_queries, text_queries  # noqa: F401
from .plans.base import ORACLE_SQL, QUERIES  # noqa: F401
