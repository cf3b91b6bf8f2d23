"""latentspark: latent-variable path modelling and survey/corpus data processing on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel whole, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
