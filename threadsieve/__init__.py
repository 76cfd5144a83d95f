"""Message-classification analytics expressed as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame (models excepted), so
it can be chained with ``df.transform`` and is planned by Catalyst as a whole.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
