"""Spark-native corpus collection, retrieval and activity analysis."""

import sys

from pyspark import cloudpickle

from corpusflow.session import build_session, materialise, prepare, scratch_dir

# Functions that run in tasks travel by value, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "materialise", "prepare", "scratch_dir"]
