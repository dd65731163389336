"""Operators for text corpora; nothing outside this folder imports them.

Functions that run inside tasks travel with the job, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
