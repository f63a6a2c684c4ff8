"""Operators for preparing training text: nothing else in the library imports this package.

Functions of this package travel to the Python workers by value, so executors
need numpy, pyarrow and the named libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def all_queries():
    """Every query of the package by name."""
    from .queries import QUERIES

    return dict(QUERIES)


def all_oracles():
    """SQL for the queries that SQL can express."""
    from .queries import ORACLES

    return dict(ORACLES)
