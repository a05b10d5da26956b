"""gradeloom: scored-text corpora as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the task, so no executor needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
