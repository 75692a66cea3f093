"""Thawline: cold-start recommendation analytics and corpus operators as Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# Workers receive the functions by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
