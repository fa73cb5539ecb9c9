"""Change-frequency analytics over version-controlled source trees, on Spark.

Functions of this package that run on executors are shipped by value, so that
a cluster needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
