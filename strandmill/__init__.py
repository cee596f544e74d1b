"""Record-oriented text, web-archive and sequence-annotation workflows on Spark."""

import sys

from pyspark import cloudpickle

# tasks get this package's functions by value, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
