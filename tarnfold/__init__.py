"""tarnfold: feature reduction, kernel statistics and model evaluation over Spark tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in tasks travel with the plan, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
