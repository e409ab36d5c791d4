"""optiq: multiple-choice evaluation analytics on Spark.

The few Python functions that run inside Spark tasks (pandas UDFs for the
distribution tails and the stemmer) are shipped by value with the task, so
executors need no installed copy of this package.
"""

import sys

try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: package must be installed on executors
    pass

__version__ = "0.1.0"
