"""Preparation, class-balanced synthesis and fidelity checks for longitudinal tables on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
