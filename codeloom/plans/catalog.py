"""All registered queries."""

from codeloom.plans import (  # noqa: F401
    change_queries,
    code_queries,
    lookup_queries,
    plandoc_queries,
    rank_queries,
    search_queries,
    walk_queries,
)
from codeloom.plans.registry import QUERIES, SQL  # noqa: F401
