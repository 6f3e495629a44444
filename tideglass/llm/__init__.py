"""Training-data operators: text filters, near-duplicate search, mixing, packing, media columns."""

import sys

from pyspark import cloudpickle

# Python workers get our functions with the task, so that no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
