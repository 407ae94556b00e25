"""airsignal — environmental time-series features, insights and forecasts on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or ``-> Column``) built
from the public PySpark API. Series operators take ``keys`` (the location
columns every window is partitioned by) and ``ts`` (the order column).
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions that run inside of Spark tasks are pickled by value: executors need numpy, pandas and pyarrow, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
