"""Analysis of social-media text as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions go to the Python workers as code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
