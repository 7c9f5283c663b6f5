"""Corpus search, evidence analytics and training-data operators on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# functions go to the workers with their code, wherever the package is installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
