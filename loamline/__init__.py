"""A Spark-first engine for document retrieval, and operators for training-data corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package that run on executors travel with the job, so that
# the cluster needs no copy of the package on its own paths.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
