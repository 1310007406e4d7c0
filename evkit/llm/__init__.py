"""Operators of a training-data pipeline: licence scans, binary ids, dedup, mixing, packing, scoring,
web archives, vector dedup and personal data. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so the workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
