"""Training-data operators: near-duplicates, token output, extraction, scoring, packing, media, search.

Their functions travel to the executors by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
