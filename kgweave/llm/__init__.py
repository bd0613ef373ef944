"""Operators for preparing training corpora; nothing else in the library imports this subpackage.

Task functions are shipped to the workers by value, so executors do not need the package on their path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
