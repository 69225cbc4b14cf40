"""Training-data operators: quality, duplicates, contamination, secrets, licences, mixing, HTML and web archives.

Functions that run in Python workers travel with the plan (by value), so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
