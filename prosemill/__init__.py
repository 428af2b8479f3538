"""prosemill: prose analytics as declarative Spark plans."""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
