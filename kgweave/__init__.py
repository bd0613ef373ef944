"""kgweave: document -> knowledge graph -> retrieval -> evaluation, as Spark DataFrame plans."""
import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
