"""broadloom: broadcast-schedule and site-usage analytics as PySpark DataFrame operators.

Functions sent to executors are pickled by value: executors need the libraries that a
function uses, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
