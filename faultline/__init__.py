"""Condition-finding triage as Spark jobs: routing, grading facts, ranking, review and measurement."""

import sys

from pyspark import cloudpickle

# Scorer wrappers travel to the workers with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
