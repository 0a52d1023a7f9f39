"""Spark-native operators for analytic query shapes, corpus curation, profiling,
SQL-text analytics, evaluation, vector retrieval and telemetry."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
