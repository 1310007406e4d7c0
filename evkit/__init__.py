"""Expected-value analytics on event logs, written with the Spark DataFrame API."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so the workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
