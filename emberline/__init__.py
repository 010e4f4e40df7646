"""Emberline: satellite thermal-detection analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no installed copy: helpers used inside tasks travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
