"""All registered queries (importing the modules fills the registry)."""

from netsieve.plans import (model_queries, prep_queries, profile_queries, row_queries,  # noqa: F401
                            seq_metric_queries, standin_queries)
from netsieve.plans.registry import ORACLE, QUERIES

FLAGSHIP = "label_distribution"

__all__ = ["QUERIES", "ORACLE", "FLAGSHIP"]
