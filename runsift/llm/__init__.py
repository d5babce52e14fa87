"""Operators of a training-data pipeline: scoring, dedup, search, token counts, mixing and archive audits.

The functions that run inside tasks travel with the tasks, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
