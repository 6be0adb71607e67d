"""gridspark: hourly-series analytics as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame.  Facts are long:
one row per (series columns, UTC timestamp), unique on that key once they have
been rolled up or deduplicated.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so no worker needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
