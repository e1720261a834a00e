"""Operators of a training-data pipeline over a corpus of documents; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Worker functions of this subpackage travel with their tasks: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
