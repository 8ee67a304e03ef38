"""The registered queries: each Spark query beside the SQL that gives the same rows in another engine."""

import sys

from pyspark import cloudpickle

from catalog import (  # noqa: F401
    evaluation_queries,
    image_queries,
    queue_queries,
    report_queries,
    roundtrip_queries,
    run_queries,
    scoring_queries,
)
from catalog.registry import ORACLES, QUERIES

# The formula scorers travel to the workers with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ORACLES", "QUERIES"]
