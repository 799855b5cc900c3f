"""Training-data operators: ten large-scale text components built on PySpark.

Nothing else in the library imports this subpackage.  ``registry`` holds the
thin ``opN_<name>`` queries and their oracle SQL.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors by value, so that these need
# no copy of the repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
