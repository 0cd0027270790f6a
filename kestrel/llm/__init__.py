"""Operators for preparing training corpora.

Nothing outside this subpackage imports it.  Functions that run on the executors are pickled by value, so a cluster needs
PySpark, numpy and pyarrow on its workers but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
