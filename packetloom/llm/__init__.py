"""Training-data operators: secrets, contamination, neighbours, personal data, duplicates, quality, packing, archives,
main text, conversations, search.

Worker functions of this package are shipped by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
