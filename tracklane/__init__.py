"""Sensor time-series analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry their code along, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
