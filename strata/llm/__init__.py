"""Operators for building training data: filters, near-duplicate search, decontamination,
classifiers, secret scans, mixing and chat formatting.

Nothing else in the library imports this package. Its worker-side functions are pickled
by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(sys.modules[__name__])
