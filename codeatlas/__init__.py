"""codeatlas: Spark jobs that turn source repositories and text corpora into queryable tables."""

import sys

from pyspark import cloudpickle

# Functions for the tasks travel with their code: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
