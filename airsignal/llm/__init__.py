"""Training-data operators: tokenising, near and exact deduplication, fingerprints, scans, classifiers, mixing.

Nothing else in the library imports this subpackage. The functions that run inside Spark tasks are
pickled by value, so executors need numpy, pyarrow and the named public libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
