"""Operators for training-data pipelines; nothing else in the library imports them.

Functions of this folder that run in tasks travel with the job, so that executors
need the installed libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
