"""Spark jobs that profile, classify and cluster payment chains.

Functions that run inside tasks travel with the job by value, so executors need
no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
